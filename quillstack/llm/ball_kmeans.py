"""Ball k-means: exact Lloyd rounds in which a vector is only compared with the centroids that can win it.

A cluster is a ball: its centroid and the distance of its farthest member. Only a centroid nearer than
twice that radius can win a member; these are the ball's neighbours, nearest first. A member at distance d
from its own centroid can only be won by a centroid within 2d, so that members inside half the distance to
the nearest neighbour, the stable core, aren't compared at all, and those of the n-th ring around it only
with the first n neighbours. All of this is in whole numbers; a square root only widens a radius.

The driver holds the centroids, their balls and a sum for each of their components, nothing that grows with
the vectors; each round is one pass over a written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import discard, materialize

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@dataclass(frozen=True)
class Balls:
    """centroids: a row each. neighbours: of each ball, nearest first. rings: the least squared distance from the
    ball's centroid at which a member can be as near to that neighbour."""

    centroids: np.ndarray
    neighbours: list[np.ndarray]
    rings: list[np.ndarray]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def make_balls(centroids: np.ndarray, radii: np.ndarray) -> Balls:
    """Balls of the given radii, which may be too large but not too small."""
    neighbours, rings = [], []
    for b, c in enumerate(centroids):
        gap = squares(centroids, c)
        near = np.flatnonzero(np.sqrt(gap.astype(float)) <= 2 * radii[b] * (1 + 1e-9) + 1e-6)
        near = near[near != b]
        near = near[np.lexsort((near, gap[near]))]
        neighbours.append(near)
        rings.append((gap[near] + 3) // 4)  # d * 4 >= gap, in whole numbers
    return Balls(centroids, neighbours, rings)


def assign(x: np.ndarray, own: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row of x, the smaller number of ties, and its squared distance. own: the balls that they are in."""
    cluster, distance = own.copy(), np.zeros(len(x), dtype=np.int64)
    for b in np.unique(own):
        rows = np.flatnonzero(own == b)
        best = squares(x[rows], balls.centroids[b])
        at = np.full(len(rows), b, dtype=own.dtype)
        reach = np.searchsorted(balls.rings[b], best, side="right")  # 0 in the stable core
        for n in range(int(reach.max())):
            j, ring = balls.neighbours[b][n], np.flatnonzero(reach > n)
            d = squares(x[rows[ring]], balls.centroids[j])
            won = (d < best[ring]) | ((d == best[ring]) & (j < at[ring]))
            best[ring[won]], at[ring[won]] = d[won], j
        cluster[rows], distance[rows] = at, best
    return cluster, distance


def quantized(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id, v (array of int): the vectors that take part, as floor(scale * x)."""
    most = isqrt((2**63 - 1) // dim) // 2 - 1  # no squared distance leaves a long
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    whole = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= most / scale))
    return rows.where((F.size("x") == dim) & whole).select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("int")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _assigned(rows: DataFrame, balls: Balls, dim: int) -> DataFrame:
    """vec_id, v, cluster, distance: the rows with their new cluster. Without a column cluster all are in ball 0."""
    shared = rows.sparkSession.sparkContext.broadcast(balls)
    first = "cluster" not in rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.zeros(b.num_rows, dtype=np.int32) if first else b.column(2).to_numpy().astype(np.int32)
            cluster, distance = assign(_matrix(b.column(1), dim), own, shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster), pa.array(distance)], names=["vec_id", "v", "cluster", "distance"])

    return rows.select("vec_id", "v", *([] if first else ["cluster"])).mapInArrow(work, "vec_id long, v array<int>, cluster int, distance long")


def _moved(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids moved to the floor of their members' mean, and how far members can be from them now."""
    dim = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            x, cluster, distance = _matrix(b.column(0), dim), b.column(1).to_numpy(), b.column(2).to_numpy()
            for c in np.unique(cluster).tolist():
                mine = cluster == c
                s = sums.setdefault(c, [np.zeros(dim, dtype=np.int64), 0, 0])
                s[0], s[1], s[2] = s[0] + x[mine].sum(axis=0), s[1] + int(mine.sum()), max(s[2], int(distance[mine].max()))
        for c, (total, n, far) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], type=pa.int32()), pa.array([total.tolist()], type=pa.list_(pa.int64())), pa.array([n]), pa.array([far])], names=["cluster", "sums", "n", "far"])

    parts = rows.select("v", "cluster", "distance").mapInArrow(work, "cluster int, sums array<long>, n long, far long")
    parts = parts.select("cluster", "n", "far", F.posexplode("sums").alias("i", "part"))
    found = parts.groupBy("cluster", "i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"), F.max("far").alias("far")).collect()  # a row for each component of a centroid
    moved, far = centroids.copy(), np.zeros(len(centroids))
    for r in found:
        moved[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
        far[r["cluster"]] = r["far"]
    shift = np.sqrt(np.einsum("ij,ij->i", (moved - centroids).astype(float), (moved - centroids).astype(float)))
    return moved, np.sqrt(far) + shift


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that takes part.

    vectors: vec_id, embedding. Components become floor(scale * x). Vectors that are null, of another length
    than ``dim`` or with components that are null, not finite or so large that a squared distance would leave
    a long (beyond about 3 million at the defaults) take no part. Centroids start as the k vectors with the
    smallest SHA-256 of "seed:vec_id", equal hashes in order of their vectors; with fewer vectors there are as
    many centroids. Each round assigns every vector to the nearest centroid, ties to the smaller number, and
    moves each centroid with members to the floor of their mean; then vectors are assigned once more.
    Rows that repeat are rows of their own; a row without vec_id is clustered but comes last as a start; an
    empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = materialize(quantized(vectors, dim, scale), "balls-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = rows.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()  # k vectors
    if not starts:
        return spark.createDataFrame([], RESULT)
    centroids, radii = np.array([r["v"] for r in starts], dtype=np.int64), np.full(len(starts), np.inf)
    for turn in range(rounds + 1):
        before, rows = rows, materialize(_assigned(rows, make_balls(centroids, radii), dim), "balls-round")
        discard(before)
        if turn < rounds:
            centroids, radii = _moved(rows, centroids)
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    named = [(c, str(sums.get(c, 0)), ",".join(map(str, m))) for c, m in enumerate(centroids.tolist())]
    named = F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia string, m string"))  # k rows
    out = rows.drop("v").join(named, "cluster")
    whole = lambda c: c.try_cast("long")
    return out.select("vec_id", "cluster", "distance", whole(F.col("cluster_inertia")).alias("cluster_inertia"), whole(F.lit(str(sum(sums.values())))).alias("inertia"), F.sha2("m", 256).alias("centroid_sha256"))
