"""SimHash near-duplicates through a binary-trie self-join.

Every text gets a 64-bit fingerprint of its word shingles; fingerprints at few differing bits are linked.
The trie is dealt out by its nodes: with the bits in four blocks, two fingerprints at two or fewer
differing bits agree on two blocks at least, so for each of the six ways to put two blocks in front, they
lie below one node of depth 32 in one of six tries. Below each such node the trie is joined with itself:
node pairs descend together, differing bits add up, and a pair goes as soon as it exceeds the budget.
What a subtree joins is handed on as a star from its least member, never as all pairs.

A node with many members (texts that differ by little from thousands of others) is dealt out once more in
the same way: of the four blocks of its other 32 bits two come in front, and the nodes of depth 48, which
have 2 ** 16 members at most, are joined instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.arrow_text import map_texts
from quillstack.llm.common import connected_components, materialize, named

BUDGET = 2
#: Members beyond which a node is dealt out by 16 further bits; 2 ** -16 of all fingerprints at least, so that the
#: nodes dealt again are few enough to broadcast. Node pairs held at a time; others wait as ranges.
NODE_MEMBERS, NODES_LOG2, PAIRS_HELD = 1024, 16, 1 << 19


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles as a signed integer; 0 without words."""
    tokens = text.encode().lower().split()  # A-Z only, and split at \x20 and \x09-\x0D: both act on bytes
    if not tokens:
        return 0
    line = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return int(np.uint64(digest(line, seed)).astype(np.int64))
    spaces = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(line)][words - 1 :]
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends, strict=False)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed long) for every row of ``docs`` (doc_id, text)."""
    return map_texts(docs, "fp long", lambda: lambda texts: [[fingerprint(t, words, seed) for t in texts]])


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First index in [lo, hi) of the sorted ``values`` with ``bit`` set, for nodes that agree above it."""
    top = (values[lo] >> np.uint64(bit + 1)) << np.uint64(bit + 1) | np.uint64(1 << bit)
    return np.clip(np.searchsorted(values, top), lo, hi)


def trie_pairs(values: np.ndarray, roots: np.ndarray, depth: int, budget: int = BUDGET, held: int = PAIRS_HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of sorted distinct ``values`` within ``budget`` differing bits below each root, in lots.

    roots: (lo, hi) ranges of the nodes at ``depth``. A node is a range of the sorted values. Of more than
    ``held`` node pairs only the first ones descend at once, so that memory follows the depth, not the pairs.
    """
    a0, a1 = roots[:, 0].astype(np.int64), roots[:, 1].astype(np.int64)
    waiting = [(63 - depth, (a0, a1, a0, a1, np.zeros(len(roots), dtype=np.int64)))]
    while waiting:
        bit, pairs = waiting.pop()
        if len(pairs[0]) > held:
            waiting += [(bit, tuple(x[held:] for x in pairs)), (bit, tuple(x[:held] for x in pairs))]
            continue
        a0, a1, b0, b1, err = pairs
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():  # two leaves: what remains differs as their values do
            i, j = a0[single], b0[single]
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any():
                yield np.minimum(i, j)[near], np.maximum(i, j)[near]
            a0, a1, b0, b1, err = (x[~single] for x in (a0, a1, b0, b1, err))
        if bit < 0 or not len(a0):
            continue
        am, bm = _split(values, a0, a1, bit), _split(values, b0, b1, bit)
        other = (a0 != b0) | (a1 != b1)
        below = [(a0, am, b0, bm, err, None), (am, a1, bm, b1, err, None), (a0, am, bm, b1, err + 1, None), (am, a1, b0, bm, err + 1, other)]
        kept = []
        for p0, p1, q0, q1, e, only in below:
            ok = (p1 > p0) & (q1 > q0) & (e <= budget)
            if only is not None:
                ok &= only  # a node's own halves meet once
            kept.append([x[ok] for x in (p0, p1, q0, q1, e)])
        waiting.append((bit - 1, tuple(np.concatenate(x) for x in zip(*kept, strict=True))))


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Let ``label``, by index the least index known to be linked to it, take in the links between ``i`` and ``j``."""
    while True:
        a, b = label[i], label[j]
        if not (apart := a != b).any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


#: Ways to put two of four blocks in front.
FRONTS = list(combinations(range(4), 2))


def _fronted(x: np.ndarray, front: tuple[int, int], width: int) -> np.ndarray:
    """The four blocks of ``width`` bits with two of them in front."""
    out = np.zeros_like(x)
    for at, k in enumerate([*front, *[k for k in range(4) if k not in front]]):
        out |= ((x >> np.uint64(width * (3 - k))) & np.uint64((1 << width) - 1)) << np.uint64(width * (3 - at))
    return out


def _placed(fp: np.ndarray, way: int, depth: int) -> np.ndarray:
    """Fingerprints with the bits in the order of a trie: ``way`` is a front of 16-bit blocks, at depth 48 six times that and a front of the 8-bit blocks of the other half."""
    if depth == 32:
        return _fronted(fp, FRONTS[way], 16)
    x = _fronted(fp, FRONTS[way // 6], 16)
    low = np.uint64(0xFFFFFFFF)
    return (x & ~low) | _fronted(x & low, FRONTS[way % 6], 8)


def join_nodes(node: np.ndarray, fp: np.ndarray, depth: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Star edges between the fingerprints of whole nodes (way << depth | leading bits), joined node by node."""
    left, right = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
    ways = node >> depth
    for way in np.unique(ways):
        own = fp[ways == way]
        value = _placed(own, int(way), depth)
        order = np.argsort(value)
        own, value = own[order], value[order]
        head = value >> np.uint64(64 - depth)
        bounds = np.flatnonzero(np.r_[True, head[1:] != head[:-1], True])
        roots = np.stack([bounds[:-1], bounds[1:]], axis=1)
        label = np.arange(len(own))
        for i, j in trie_pairs(value, roots[roots[:, 1] - roots[:, 0] > 1], depth):
            _unite(label, i, j)
        far = np.flatnonzero(label != np.arange(len(own)))
        left.append(own[label[far]])
        right.append(own[far])
    return np.concatenate(left), np.concatenate(right)


def _stream_nodes(depth: int):
    """Joins rows (node, fp) that come sorted by node, as many whole nodes at once as a batch has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def edges(n, f):
            several = np.flatnonzero(n[1:] == n[:-1])
            use = np.union1d(several, several + 1)
            a, b = join_nodes(n[use], f[use], depth)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        wait_n, wait_f = [], []  # the rows of one node
        for batch in batches:
            n, f = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(n):
                continue
            if wait_n and wait_n[0][0] == n[-1]:
                wait_n.append(n)
                wait_f.append(f)
                continue
            node, fp = np.concatenate([*wait_n, n]), np.concatenate([*wait_f, f])
            last = int(np.searchsorted(node, node[-1]))
            yield from edges(node[:last], fp[:last])
            wait_n, wait_f = [node[last:]], [fp[last:]]
        if wait_n:
            yield from edges(np.concatenate(wait_n), np.concatenate(wait_f))

    return work


def _deal_deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, fp) of nodes at depth 32 as rows of the six nodes at depth 48 that the fingerprint is below."""
    for batch in batches:
        node, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        for front in range(6):
            ways = (node >> 32) * 6 + front
            out = np.empty(len(node), dtype=np.int64)
            for way in np.unique(ways):
                at = ways == way
                out[at] = (_placed(fp[at], int(way), 48) >> np.uint64(16)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ways << 48 | out), batch.column(1)], names=["node", "fp"])


def near_edges(nodes: DataFrame, members: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``nodes`` (fp) just as all links within two bits do.

    Nodes of more than ``members`` fingerprints are joined at depth 48, the others at depth 32: the same join either way.
    """
    most = members or max(NODE_MEMBERS, nodes.count() >> NODES_LOG2)
    block = [F.shiftrightunsigned("fp", 48 - 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    fronts = [F.lit(c << 32) + block[i] * 65536 + block[j] for c, (i, j) in enumerate(FRONTS)]
    dealt = nodes.select(F.explode(F.array(*fronts)).alias("node"), "fp")
    many = materialize(dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("node"), "simhash-many")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def joined(rows: DataFrame, depth: int) -> DataFrame:
        return rows.repartition(n, "node").sortWithinPartitions("node").mapInArrow(_stream_nodes(depth), "a long, b long")

    if many.isEmpty():
        return materialize(joined(dealt, 32), "simhash-edges")
    many = F.broadcast(many)  # 6 * 2 ** NODES_LOG2 nodes at most
    deeper = dealt.join(many, "node", "left_semi").mapInArrow(_deal_deeper, "node long, fp long")
    return materialize(joined(dealt.join(many, "node", "left_anti"), 32).union(joined(deeper, 48)), "simhash-edges")


def near_components(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id for every row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable over links of two or fewer differing bits. Texts without
    words (null, empty, white space) have fingerprint 0 and are linked like any other; fewer words than a
    shingle make one shingle; rows without a doc_id join their component but don't name it; repeated rows
    give repeated rows; an empty table gives none; other columns are ignored.
    """
    signed = materialize(fingerprints(docs, words, seed), "simhash-docs")
    nodes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    label = connected_components(near_edges(nodes.select("fp")))
    rooted = materialize(nodes.join(label, nodes["fp"] == label["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "simhash-named")
    return signed.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one document of each component, the one with the least doc_id, in the same columns.

    Texts without words (null, empty, white space) are one component; texts of any length are read whole;
    rows without a doc_id stay, and so do rows that repeat the doc_id which stays; an empty table gives
    none; columns may have any names.
    """
    copies = near_components(docs, words, seed).where("doc_id <> component_id").select(F.col("doc_id").alias("_copy"))
    rows = docs.select(F.col("doc_id").alias("_id"), F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row"))
    kept = rows.join(materialize(copies, "simhash-copies"), F.col("_id") == F.col("_copy"), "left_anti")
    return kept.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
