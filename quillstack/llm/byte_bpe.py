"""Byte-level BPE encoding and decoding by two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a token. Tier two:
a pre-token outside the vocabulary is merged byte by byte, the pair of least rank first, through a heap
over doubly linked pieces, in O(n log n) for a pre-token of any length. A bounded memory of recent
pre-tokens stands before both tiers.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from quillstack.llm.arrow_text import map_texts

#: Pre-tokens remembered by a task, and the longest that is remembered.
MEMORY, LONGEST = 600_000, 64


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a .tiktoken file (base64 and rank on each line)."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class PerfectHash:
    """Minimal perfect hash by hash and displace: a key's bucket holds the seed that sends it to its own slot.

    Slots hold the key's id; a lookup compares the bytes, as keys outside the set reach some slot too.
    """

    def __init__(self, keys: list[tuple[bytes, int]], load: int = 4):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // load)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k, _ in keys], dtype=np.uint64)
        self.seeds = [0] * self.buckets
        self.slots: list[tuple[bytes, int] | None] = [None] * n
        groups: dict[int, list[int]] = {}
        for i, b in enumerate((h % np.uint64(self.buckets)).tolist()):
            groups.setdefault(b, []).append(i)
        values = h.tolist()
        for b, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            seed = 0
            while True:
                places = [self._place(values[i], seed) for i in members]
                if len(set(places)) == len(places) and all(self.slots[p] is None for p in places):
                    break
                seed += 1
            self.seeds[b] = seed
            for i, p in zip(members, places, strict=True):
                self.slots[p] = keys[i]

    def _place(self, h: int, seed: int) -> int:
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        found = self.slots[self._place(h, self.seeds[h % self.buckets])]
        return found[1] if found is not None and found[0] == key else None


class BytePairs:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, tokens: list[bytes], table: PerfectHash, pattern: str):
        import regex

        self.tokens, self.table = tokens, table
        self.ranks = {t: i for i, t in enumerate(tokens) if t}  # of the pairs that tier two meets
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token: adjacent parts are merged while some pair is a token, least rank and leftmost first.

        Heap entries are single integers: rank, start and end of the pair, each in its own bits.
        """
        if (whole := self.table.get(piece)) is not None:
            return (whole,)
        get, n = self.ranks.get, len(piece)
        bits = n.bit_length()
        low = (1 << bits) - 1
        end = list(range(1, n + 1))  # of the part that starts at i; 0 once it is merged into its left
        left = list(range(-1, n - 1))
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            pair = heappop(heap)
            stop = pair & low
            i = pair >> bits & low
            j = end[i]
            if not j or j >= n or end[j] != stop:  # one of the two has changed since
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                left[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heappush(heap, (r << bits | i) << bits | end[stop])
            if (k := left[i]) >= 0 and (r := get(piece[k:stop])) is not None:
                heappush(heap, (r << bits | k) << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(get(piece[i : end[i]]))
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for piece in self.split(text):
            got = known.get(piece)
            if got is None:
                got = self.merge(piece.encode())
                if len(piece) <= LONGEST:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[piece] = got
            ids.append(got)
        return list(chain.from_iterable(ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _shared(spark: SparkSession, path: str):
    tokens = read_ranks(path)
    table = PerfectHash([(t, i) for i, t in enumerate(tokens) if t])
    return spark.sparkContext.broadcast((tokens, table))  # one vocabulary: its size doesn't follow the corpus


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) for every row of ``docs`` (doc_id, text). Null texts have no ids."""
    shared = _shared(docs.sparkSession, path)

    def make():
        coder = BytePairs(*shared.value, pattern)
        return lambda texts: [[coder.encode(t) for t in texts]]

    return map_texts(docs, "ids array<int>", make)


def encoded_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs`` (doc_id, text).

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the bytes that decoding the ids
    gives. A null text is empty: no tokens, and both digests are of nothing. Repeated rows give repeated
    rows; an empty table gives none; other columns are ignored.
    """
    shared = _shared(docs.sparkSession, path)

    def make():
        coder = BytePairs(*shared.value, pattern)
        names = [str(i) for i in range(len(coder.tokens))]

        def f(texts):
            counts, ids_digest, decoded_digest = [], [], []
            for t in texts:
                ids = coder.encode(t)
                counts.append(len(ids))
                ids_digest.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded_digest.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            return [counts, ids_digest, decoded_digest]

        return f

    return map_texts(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
