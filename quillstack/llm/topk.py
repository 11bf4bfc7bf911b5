"""Exact top-k inner products through a pivot-distance index.

With every vector lengthened by one coordinate to the same norm, the largest inner product with a query is
the least distance to it. Vectors are keyed by their nearest pivot and the distance to it; sorted by that
key they form annuli of bounded size. A query's annuli are expanded in the order of their lower bounds: its
own first, then waves of the next ones, each wave tightening the distance of its k-th neighbour, until the
triangle inequality rules out all that are left.

A pack holds the queries of one annulus, so the first annulus is searched where it lies. In a later wave the
annuli that any pack has to see meet the packs in tasks of their own; the others aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import materialize

#: Rows that pivots are fitted on (they are as many as the root of all rows, a quarter of these rows at most), most rows of an annulus, annuli a wave (the last one takes all that remain).
FIT_ROWS, ANNULUS_ROWS, WAVES = 4096, 2048, (8, None)
#: Sums of products below these are exact as doubles and as longs; beyond, Python's integers are used. Scores saturate at the limits of a long.
DOUBLE_MOST, LONG_MOST = float(1 << 52), float(1 << 61)
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """row (a number of its own), vec_id, v (floor(scale * x) of each component as packed doubles) and norm (their
    sum of squares), for rows with an id and only finite components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2)
            at, flat = column.offsets.to_numpy(), np.floor(column.values.to_numpy(zero_copy_only=False))
            parts = [flat[x:y] for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p.tobytes() for p in parts], type=pa.binary()), pa.array([float(p @ p) for p in parts], type=pa.float64())], names=["row", "vec_id", "v", "norm"])

    ok = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf"))), F.lit(False))
    v = F.transform("embedding", lambda x: x.cast("double") * scale)
    rows = vectors.where(ok).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.mapInArrow(work, "row long, vec_id long, v binary, norm double")


@np.errstate(over="ignore", invalid="ignore")
def fit_pivots(sample: np.ndarray, n: int, steps: int = 6) -> np.ndarray:
    """Pivots near the means of the sample's clusters: farthest points first, then a few rounds of means."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [sample[0]]
    least = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < n and least.max() > 0:
        chosen.append(sample[least.argmax()])
        least = np.minimum(least, ((sample - chosen[-1]) ** 2).sum(axis=1))
    pivots = np.array(chosen)
    for _ in range(steps):
        near = _distances(sample, pivots).argmin(axis=1)
        for p in np.unique(near):
            pivots[p] = sample[near == p].mean(axis=0)
    return pivots


@np.errstate(over="ignore", invalid="ignore")
def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances from the pivots. Where squares leave a double it is as far as can be, which rules nothing out."""
    d2 = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(np.nan_to_num(d2, nan=np.inf, posinf=np.inf, neginf=np.inf), 0))


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows, shorter ones filled up with zeros."""
    if all(len(b) == 8 * dim for b in blobs):
        return np.frombuffer(b"".join(blobs)).reshape(-1, dim)
    out = np.zeros((len(blobs), dim))
    for i, b in enumerate(blobs):
        out[i, : len(b) // 8] = np.frombuffer(b)
    return out


@np.errstate(over="ignore", invalid="ignore")
def _lengthened(v: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))[:, None]])


def _keyed(rows: DataFrame, shared, dim: int, most: float) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            v = _matrix(b.column(2).to_pylist(), dim)
            d = _distances(_lengthened(v, most), pivots)
            near = d.argmin(axis=1)
            packed = pa.array([r.tobytes() for r in v], type=pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(v)), near]), packed], names=["row", "vec_id", "pivot", "dist", "v"])

    return rows.mapInArrow(work, "row long, vec_id long, pivot int, dist double, v binary")


def _annuli(keyed: DataFrame, n_rows: int, most_rows: int) -> DataFrame:
    """annulus, pivot, lo, hi, rows, ids, vs: runs of at most ``most_rows`` rows of one pivot, sorted by distance."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 32, 0
        kept: list[tuple] = []

        def out():
            rows, ids = (np.array([r[c] for r in kept], dtype=np.int64).tobytes() for c in (0, 1))
            blobs = [pa.array([x], type=pa.binary()) for x in (rows, ids, b"".join(r[4] for r in kept))]
            return pa.RecordBatch.from_arrays([pa.array([part + made]), pa.array([kept[0][2]], type=pa.int32()), pa.array([kept[0][3]]), pa.array([kept[-1][3]]), *blobs], names=["annulus", "pivot", "lo", "hi", "rows", "ids", "vs"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kept and (kept[0][2] != row[2] or len(kept) >= most_rows):
                    yield out()
                    kept, made = [], made + 1
                kept.append(row)
        if kept:
            yield out()

    parts = max(1, -(-n_rows // (4 * most_rows)))
    order = ["pivot", "dist", "vec_id", "row"]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(work, "annulus long, pivot int, lo double, hi double, rows binary, ids binary, vs binary")


def sortable(x: int) -> bytes:
    """Bytes in the order of the numbers, of any size: sign, length, digits; complemented below 0."""
    size = (abs(x).bit_length() + 7) // 8
    found = size.to_bytes(4, "big") + abs(x).to_bytes(size, "big")
    return b"\x01" + found if x >= 0 else b"\x00" + bytes(255 - c for c in found)


class Scorer:
    """Exact inner products with the vectors of an annulus, in numbers large enough for sums up to ``most``."""

    def __init__(self, dim: int, k: int, most: float):
        self.dim, self.k, self.most = dim, k, most

    def numbers(self, packed: bytes) -> np.ndarray:
        v = np.frombuffer(packed).reshape(-1, self.dim)
        if self.most < DOUBLE_MOST:
            return v
        return v.astype(np.int64) if self.most < LONG_MOST else np.frompyfunc(int, 1, 1)(v)

    def best(self, scores: np.ndarray, ids: np.ndarray) -> list[int]:
        """Places of the k largest scores, ties to the smaller id."""
        if scores.dtype == object:
            return sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[: self.k]
        some = np.arange(len(scores))
        if len(scores) > 4 * self.k:
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
        return some[np.lexsort((ids[some], -scores[some]))[: self.k]].tolist()

    def found(self, annulus: tuple, queries: tuple, least: np.ndarray) -> list[tuple]:
        """(query row, query_id, vec_id, score, beyond) of each query's best rows that reach its least score.

        annulus: rows, ids, vectors; queries: rows, ids, vectors. beyond orders scores that saturate.
        """
        rows, ids, v = annulus
        q_rows, q_ids, q = queries
        s = q @ v.T if len(q) and len(v) else np.zeros((len(q), len(v)))
        s = s.astype(np.int64) if s.dtype == float else s
        out = []
        for r in range(len(q_rows)):
            ok = np.flatnonzero(((s[r] >= least[r]) & (rows != q_rows[r])).astype(bool))
            for i in self.best(s[r][ok], ids[ok]):
                x = int(s[r][ok[i]])
                beyond = sortable(x) if not LOW < x < HIGH else None
                out.append((int(q_rows[r]), int(q_ids[r]), int(ids[ok[i]]), min(max(x, LOW), HIGH), beyond))
        return out


FOUND = "query long, query_id long, vec_id long, score long, beyond binary"


def _found_batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], type=t) for c, t in enumerate(kinds)], names=["query", "query_id", "vec_id", "score", "beyond"])


def _longs(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.int64)


def _own(annuli: DataFrame, scorer: Scorer, every: int) -> DataFrame:
    """What the queries of each annulus find in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, ids, vs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                here = _longs(rows), _longs(ids), scorer.numbers(vs)
                own = np.flatnonzero(here[1] % every == 0)
                yield _found_batch(scorer.found(here, tuple(x[own] for x in here), np.full(len(own), LOW)))

    return annuli.select("rows", "ids", "vs").mapInArrow(work, FOUND)


def _visit(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """What packs find, from rows (annulus, pack, rows, ids, vs, kth) sorted so that an annulus itself (pack null) precedes the packs that visit it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, None
        for b in batches:
            for annulus, pack, rows, ids, vs, kth in zip(*(c.to_pylist() for c in b.columns), strict=True):
                these = _longs(rows), _longs(ids), scorer.numbers(vs)
                if pack is None:
                    at, here = annulus, these
                    continue
                assert at == annulus
                yield _found_batch(scorer.found(here, these, _longs(kth)))

    return rows.mapInArrow(work, FOUND)


def _queries(annuli: DataFrame, every: int) -> DataFrame:
    """pack (the annulus of the query), row, vec_id, v."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for annulus, rows, ids, vs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                size, ids, rows = len(vs) // (len(ids) // 8), _longs(ids), _longs(rows)
                own = np.flatnonzero(ids % every == 0)
                yield pa.RecordBatch.from_arrays([pa.array([annulus] * len(own), type=pa.int64()), pa.array(rows[own]), pa.array(ids[own]), pa.array([vs[i * size : (i + 1) * size] for i in own.tolist()], type=pa.binary())], names=["pack", "row", "vec_id", "v"])

    return annuli.select("annulus", "rows", "ids", "vs").mapInArrow(work, "pack long, row long, vec_id long, v binary")


def _packs(state: DataFrame, shared, dim: int, most: float) -> DataFrame:
    """pack, rows, ids, vs, kth and shells: around each pivot the distances (from, to) that a better neighbour of
    any query of the pack has, and those of the queries themselves (near, far).

    A better neighbour is nearer than the k-th one, so by the triangle inequality its distance to a pivot
    differs from the query's by less than that.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            for pack, qs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, ids, kth = (np.array([q[c] for q in qs], dtype=np.int64) for c in ("row", "vec_id", "kth"))
                v = _matrix([q["v"] for q in qs], dim)
                x = np.hstack([v, np.zeros((len(v), 1))])
                d = _distances(x, pivots)
                with np.errstate(over="ignore"):  # beyond a double: no bound
                    reach = np.sqrt(np.maximum((v * v).sum(axis=1) + most - 2.0 * kth, 0))
                reach[kth == LOW] = np.inf  # fewer than k so far, or a saturated score
                slack = 1e-6 * (1 + d + np.sqrt(most))  # for rounding
                with np.errstate(invalid="ignore"):
                    low, high = (d - reach[:, None] - slack).min(axis=0), (d + reach[:, None] + slack).max(axis=0)
                low, high = np.nan_to_num(low, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(high, nan=np.inf, posinf=np.inf, neginf=-np.inf)
                shells = [{"pivot": p, "from": float(low[p]), "to": float(high[p]), "near": float(d[:, p].min()), "far": float(d[:, p].max())} for p in range(len(pivots))]
                kind = pa.list_(pa.struct([("pivot", pa.int32()), *[(c, pa.float64()) for c in ("from", "to", "near", "far")]]))
                blobs = [pa.array([x], type=pa.binary()) for x in (rows.tobytes(), ids.tobytes(), v.tobytes(), kth.tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([pack]), *blobs, pa.array([shells], type=kind)], names=["pack", "rows", "ids", "vs", "kth", "shells"])

    grouped = state.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("row", "vec_id", "v", "kth"))).alias("qs"))  # an annulus's queries
    return grouped.mapInArrow(work, "pack long, rows binary, ids binary, vs binary, kth binary, shells array<struct<pivot:int,`from`:double,to:double,near:double,far:double>>")


def _open_pairs(packs: DataFrame, spans: DataFrame) -> DataFrame:
    """pack, annulus, bound: annuli that meet a shell of the pack, with the least distance that their rows can have from its queries."""
    shells = packs.select("pack", F.explode("shells").alias("s")).select("pack", "s.*")
    met = shells.join(spans, "pivot").where("lo <= to and hi >= `from` and annulus <> pack")
    return met.select("pack", "annulus", F.greatest(F.lit(0.0), F.col("lo") - F.col("far"), F.col("near") - F.col("hi")).alias("bound"))


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.desc_nulls_last("beyond"), F.asc("vec_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, annulus_rows: int = ANNULUS_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with all other rows.

    vectors: vec_id, embedding; queries are the rows whose vec_id is divisible by ``every``. Components become
    floor(scale * x); scores are exact integers, of any size when they are compared, and saturate at the
    limits of a long when they are returned. Ties go to the smaller vec_id. Rows that repeat a vec_id are
    rows of their own: each is a candidate for all others, and a query with an answer of its own. Rows
    without an id, null vectors and vectors with null or non-finite components take no part; a shorter
    vector counts as filled up with zeros; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = materialize(quantized(vectors, scale), "topk-rows")
    n, size, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("v")), F.lit(8)), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    dim, most = max(1, size // 8), most * (1 + 1e-9)
    scorer = Scorer(dim, k, most)
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(FIT_ROWS).select("v").collect()]  # FIT_ROWS at most
    shared = spark.sparkContext.broadcast(fit_pivots(_lengthened(_matrix(sample, dim), most), max(1, min(isqrt(n), FIT_ROWS // 4))))
    annuli = materialize(_annuli(_keyed(rows.drop("norm"), shared, dim, most), n, annulus_rows), "topk-annuli")
    queries = materialize(_queries(annuli, every), "topk-queries")
    spans = annuli.select("annulus", "pivot", "lo", "hi")
    best, visited = materialize(_merged(_own(annuli, scorer, every), k), "topk-best"), None
    for wave in WAVES:
        kth = best.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_kth"))
        state = queries.join(kth, queries["row"] == kth["query"], "left").select("pack", "row", "vec_id", "v", F.coalesce("_kth", F.lit(LOW)).alias("kth"))
        packs = materialize(_packs(state, shared, dim, most), "topk-packs")
        pairs = _open_pairs(packs, spans)
        if visited is not None:
            pairs = pairs.join(visited, ["pack", "annulus"], "left_anti")
        if wave is not None:
            turn = F.row_number().over(Window.partitionBy("pack").orderBy("bound", "annulus"))
            pairs = pairs.withColumn("turn", turn).where(F.col("turn") <= wave)
        pairs = materialize(pairs.select("pack", "annulus"), "topk-pairs")
        if pairs.isEmpty():
            break
        visited = pairs
        none = F.lit(None)
        here = annuli.join(pairs.select("annulus").distinct(), "annulus", "left_semi").select("annulus", none.cast("long").alias("pack"), "rows", "ids", "vs", none.cast("binary").alias("kth"))
        there = packs.drop("shells").join(pairs, "pack").select("annulus", "pack", "rows", "ids", "vs", "kth")
        dealt = here.unionByName(there).repartition("annulus").sortWithinPartitions("annulus", F.col("pack").asc_nulls_first())
        best = materialize(_merged(_visit(dealt, scorer).unionByName(best.drop("rank")), k), "topk-best")
    return best.select("query_id", "rank", "vec_id", "score")
