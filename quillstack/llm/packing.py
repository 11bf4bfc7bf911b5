"""Packing documents into sequences of a fixed number of tokens, after Martello and Toth.

What matters of a piece is its length, so the instance is a histogram of at most ``capacity`` numbers, however
many documents there are. The driver packs this histogram in bulk, in three steps:

* Reduction: a set of pieces that dominates every other set which a piece could be in is fixed for good, as
  often as its lengths allow. Nothing is lost by it: some optimal packing has all the fixed sets.
* Best fit, longest first, of what remains: sequences with the same contents are one class, and a run of equal
  pieces fills whole classes at a time, with the same outcome as one by one.
* The result is a list of cells (length, first rank, copies in a sequence, first sequence, offset).

Pieces get a rank among all of their length from counts by task, and look their cell up. No rows are gathered
by length, so a third of them may have the same one.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.arrow_text import slices
from quillstack.llm.common import empty_text, materialize

#: Tokens of a sequence; the id that ends each document.
CAPACITY, END = 2048, 0

Contents = tuple[tuple[int, int], ...]  # (length, copies), in the order in which they stand


# ---- the instance as a histogram -----------------------------------------------------------------


@dataclass
class Lengths:
    """How many pieces there are of each length."""

    counts: dict[int, int]
    sizes: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.counts = {s: n for s, n in self.counts.items() if n}
        self.sizes = np.array(sorted(self.counts), dtype=np.int64)

    def take(self, contents: Counter, times: int) -> None:
        for s, c in contents.items():
            self.counts[s] -= c * times
            if not self.counts[s]:
                del self.counts[s]
                self.sizes = self.sizes[self.sizes != s]

    def smallest(self, most: int, without: int) -> list[int]:
        """The ``most`` smallest pieces, one of length ``without`` aside."""
        out: list[int] = []
        for s in self.sizes[: most + 1].tolist():
            out += [s] * min(most, self.counts[s] - (s == without))
        return out[:most]

    def largest(self, limit: int, without: Counter) -> int:
        """The largest length up to ``limit`` of which there is one beyond those in ``without``; 0 if none."""
        i = int(np.searchsorted(self.sizes, limit, side="right"))
        while i and self.counts[int(self.sizes[i - 1])] <= without[int(self.sizes[i - 1])]:
            i -= 1
        return int(self.sizes[i - 1]) if i else 0


def companions(have: Lengths, w: int, capacity: int) -> tuple[int, ...] | None:
    """What to pack with a piece of length w so that no other choice can be better, or None if that isn't known.

    A set dominates another one if the other's pieces can be put into groups, each of which fits in the place
    of a different piece of the set. Sets of up to three pieces are considered: where more fit, only a piece
    that fills the sequence is known to be best.
    """
    room, own = capacity - w, Counter([w])
    low = have.smallest(3, w)
    if not low or low[0] > room:
        return ()
    a = have.largest(room, own)
    if a == room or len(low) == 1 or low[0] + low[1] > room:
        return (a,)
    if len(low) == 3 and sum(low) <= room:
        return None
    # For each length x the longest y <= x that still fits with it.
    pairs = [(x, have.largest(min(x, room - x), own + Counter([x]))) for x in have.sizes[have.sizes <= room].tolist() if have.counts[x] > own[x]]
    pairs = [(x, y) for x, y in pairs if y]
    if a >= max(x + y for x, y in pairs):
        return (a,)
    b = have.largest(room - a, own + Counter([a]))
    if b and all(y <= b or x + y <= a for x, y in pairs):
        return (a, b)
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Contents, int]], dict[int, int]]:
    """Sets fixed for good with how often each, and the counts that remain."""
    have, fixed, again = Lengths(counts), [], True
    while again:
        again = False
        for w in reversed(have.sizes.tolist()):
            # A set stays dominating while pieces vanish, as long as its own are there.
            while w in have.counts and (found := companions(have, w, capacity)) is not None:
                contents = Counter([w, *found])
                times = min(have.counts[s] // c for s, c in contents.items())
                have.take(contents, times)
                fixed.append((tuple(sorted(contents.items(), reverse=True)), times))
                again = True
    return fixed, have.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Contents, int]]:
    """Best fit decreasing: contents of sequences and how many have them."""
    open_: dict[int, list[tuple[Contents, int]]] = {}  # by the room left
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            room = min((r for r in open_ if r >= s), default=capacity)
            fill = room // s
            contents, times = open_[room].pop() if room in open_ else ((), -(-left // fill))
            if not open_.get(room, True):
                del open_[room]
            whole = min(times, left // fill)
            rest = left - whole * fill if whole < times else 0  # in one more sequence, which has room left
            for copies, n in ((fill, whole), (rest, 1 if rest else 0), (0, times - whole - bool(rest))):
                if n:
                    open_.setdefault(room - copies * s, []).append((contents + (((s, copies),) if copies else ()), n))
            left -= whole * fill + rest
    return [x for classes in open_.values() for x in classes]


@dataclass(frozen=True)
class Plan:
    """Cells in order of the place of their first piece among all pieces, shorter ones first: base (that place),
    length, copies, sequence, offset. first: the place of the first piece of each length."""

    cells: dict[str, np.ndarray]
    first: dict[int, int]
    sequences: int
    fixed: int

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces at these places."""
        c = np.searchsorted(self.cells["base"], at, side="right") - 1
        turn, nth = np.divmod(at - self.cells["base"][c], self.cells["copies"][c])
        return self.cells["sequence"][c] + turn, self.cells["offset"][c] + nth * self.cells["length"][c]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A packing of so many pieces of each length, none longer than ``capacity``."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    first, total = {}, 0
    for s in sorted(counts):
        first[s], total = total, total + counts[s]
    upto, cells, sequence = dict(first), [], 0
    for contents, times in fixed + best_fit(rest, capacity):
        offset = 0
        for s, copies in contents:
            cells.append((upto[s], s, copies, sequence, offset))
            upto[s], offset = upto[s] + copies * times, offset + copies * s
        sequence += times
    table = np.array(sorted(cells), dtype=np.int64).reshape(-1, 5)
    return Plan(dict(zip(("base", "length", "copies", "sequence", "offset"), table.T, strict=True)), first, sequence, sum(n for _, n in fixed))


# ---- documents -----------------------------------------------------------------------------------


# How byte-level BPE in this format divides a text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_letters() -> dict[str, int]:
    """The letter that stands for each byte in such a vocabulary: itself if it can be printed, else one beyond U+00FF."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """A function that encodes a text with the tokenizer in this file, one for all tasks of a worker.

    A plain byte-level BPE whose merges are in the order of their ids is a table of ranks. It is encoded by
    these, in a third of the time and a fraction of the memory, to the same ids; any other by the tokenizer.
    """
    with open(vocabulary, encoding="utf-8") as f:
        raw = json.load(f)
    model, ids = raw["model"], raw["model"].get("vocab", {})
    pre = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = raw["normalizer"] is None and {k: v for k, v in (raw["pre_tokenizer"] or {}).items() if k in pre} == pre and model["type"] == "BPE"
    if plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        if all(ids[m] == 256 + i for i, m in enumerate(merged)):
            import tiktoken

            letters, special = _bytes_of_letters(), {t["content"] for t in raw["added_tokens"]}
            ranks = {bytes(letters[c] for c in t): i for t, i in ids.items() if t not in special}
            return tiktoken.Encoding("packing", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth and, if asked for, ids: a row for every piece.

    Only documents of more than ``capacity`` ids are cut, into pieces of that many of which the first may be
    shorter. nth counts the earlier pieces of the same length of the same task. Strings of special tokens are
    ordinary text.
    """
    kinds = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "task": "int", "nth": "long", **({"ids": "array<int>"} if with_ids else {})}
    types = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for b in slices(batch, 1):
                rows: dict[str, list] = {c: [] for c in kinds}
                of = []
                for i, text in enumerate(b.column(1)):
                    ids = np.append(encode(text.as_py()), END).astype("<u4")
                    for piece, end in enumerate(range(len(ids) % capacity or capacity, len(ids) + 1, capacity)):
                        start = max(0, end - capacity)
                        part = ids[start:end]
                        of.append(i)
                        found = (piece, start, end - start, zlib.crc32(part.tobytes()), task, seen[end - start], *([part.astype(np.int32)] if with_ids else []))
                        seen[end - start] += 1
                        for c, v in zip(kinds, found, strict=True):
                            rows[c].append(v)
                cols = [b.column(0).take(pa.array(of, type=pa.int64()))] + [pa.array(rows[c], type=types[k]) for c, k in kinds.items()]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *kinds])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", empty_text().alias("text")).mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): where every piece of ``docs`` (doc_id, text) stands.

    A null text is an empty one, of which the id that ends it is left; texts of any length are encoded whole;
    rows that repeat, and rows without doc_id, are documents of their own; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    pieces = materialize(cut(docs, vocabulary, capacity, with_ids), "packing-pieces")
    by_task = materialize(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length, capacity at most
    plan = plan_packing(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))  # a row a task
    ranks = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("earlier"))
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # some cells for each length
    names = [c for c in pieces.columns if c not in ("task", "nth")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, earlier, nth = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "earlier", "nth"))
            first = np.array([shared.value.first[s] for s in length.tolist()], dtype=np.int64)
            sequence, offset = shared.value.places(first + earlier + nth)
            kept = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names).schema)
    return pieces.join(ranks, ["length", "task"]).mapInArrow(look_up, f"{fields}, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids, documents: the sequences themselves, each with its ids and, by offset, the pieces in it."""
    rows = pack_documents(docs, vocabulary, capacity, with_ids=True)
    parts = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids"))).alias("p"))  # capacity ids at most
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("documents"))
