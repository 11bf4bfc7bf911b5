"""Language-model scoring by masked pseudo-likelihood.

A small bidirectional network predicts each token from the tokens on both sides of it, the token itself
masked: window embeddings, one per offset, are added and squashed. A softmax over classes follows. The most
frequent tokens stand in classes of their own kind, in which a second softmax over the class's members
predicts the token; the others stand in bands of frequency, in which a token has its share of the corpus
counts. A document's score is the sum of the log-probabilities of all its tokens.

What the model is made of grows with the corpus: every distinct token keeps its count over all documents,
and each round sees a window around every token of every document. Tokens known to the tasks are some
multiple of the square root of the distinct ones; the counts of the rest are joined as a table when
documents are scored. Every task trains on its own documents from common weights, and the tasks' weights
are averaged, block by block, in two levels of tasks of their own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.arrow_text import slices
from quillstack.llm.common import empty_text, materialize

#: Classes with a softmax of their own and their members; bands for other known tokens; the last class has the rest.
GROUPS, MEMBERS, BANDS = 16, 128, 7
PREDICTED, CLASSES = GROUPS * MEMBERS, GROUPS + BANDS + 1
#: Known tokens for each root of the distinct ones, beside those that are predicted.
KNOWN_PER_ROOT = 16
#: Embedding rows that less frequent tokens share by hash; the predicted ones have rows of their own, the edge of a text has the last.
HASHED = 512
ROWS = PREDICTED + HASHED + 1
OFFSETS, WIDTH = (-2, -1, 1, 2), 16
assert len(OFFSETS) * ROWS < 1 << 16
#: Windows a step; step size; rounds of averaging. Windows scored at once, few enough to stay in the cache.
STEP_ROWS, STEP, ROUNDS = 2048, 1.0, 1
SCORE_ROWS = 4096
BLOCK, LOTS = 4096, 32
_REACH = max(map(abs, OFFSETS))


def tokens_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


@dataclass
class Batch:
    """Tokens of several texts in one row: windows (embedding rows around each), classes, members and shares; lengths of the texts; places and bytes of tokens that are not known."""

    windows: np.ndarray
    classes: np.ndarray
    members: np.ndarray
    share: np.ndarray
    lengths: np.ndarray
    rare_at: np.ndarray
    rare: list[bytes]


@dataclass
class Lexicon:
    """ids of the known tokens; by id (the last one stands for all others): class, member, embedding row, log share
    of its class. least: the count up to which a token may be unknown; rest: log of all occurrences of these."""

    ids: dict[bytes, int]
    classes: np.ndarray
    members: np.ndarray
    rows: np.ndarray
    share: np.ndarray
    least: int
    rest: float

    def batch(self, texts: list[str]) -> Batch:
        parts = [tokens_of(t) for t in texts]
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        tokens = [t for p in parts for t in p]
        other = len(self.ids)
        ids = np.fromiter(map(self.ids.get, tokens, repeat(other)), dtype=np.int64, count=len(tokens))
        rows, at = self.rows[ids], np.flatnonzero(ids == other)
        rare = [tokens[i] for i in at.tolist()]
        rows[at] = hashed_rows(rare)
        place = np.arange(len(ids)) + _REACH * (1 + np.repeat(np.arange(len(lengths)), lengths))  # edges stand between the texts
        wide = np.full(len(ids) + _REACH * (1 + len(lengths)), ROWS - 1)
        wide[place] = rows
        windows = np.stack([wide[place + o] for o in OFFSETS], axis=1)
        return Batch(windows, self.classes[ids], self.members[ids], self.share[ids], lengths, at, rare)


def hashed_rows(tokens: list[bytes]) -> np.ndarray:
    return PREDICTED + np.fromiter(map(zlib.crc32, tokens), dtype=np.int64, count=len(tokens)) % HASHED


def build_lexicon(counts: list[tuple[bytes, int]], total: int) -> tuple[Lexicon, np.ndarray, np.ndarray]:
    """Lexicon, log priors of the classes and of the members in them.

    counts: the most frequent tokens in order, all of those known; total: occurrences of all tokens.
    """
    n = len(counts)
    freq = np.array([c for _, c in counts], dtype=float)
    some = min(n, PREDICTED)
    classes, members = np.full(n + 1, CLASSES - 1), np.zeros(n + 1, dtype=np.int64)
    classes[:some], members[:some] = np.arange(some) // MEMBERS, np.arange(some) % MEMBERS
    if n > some:  # bands of equal mass in order of frequency
        mid = np.cumsum(freq[some:]) - freq[some:] / 2
        classes[some:n] = GROUPS + np.minimum((mid / freq[some:].sum() * BANDS).astype(np.int64), BANDS - 1)
    mass = np.bincount(classes[:n], weights=freq, minlength=CLASSES) if n else np.zeros(CLASSES)
    mass[CLASSES - 1] = total - freq.sum()
    share = np.zeros(n + 1)
    share[some:n] = np.log(freq[some:] / mass[classes[some:n]])
    rows = np.concatenate([np.arange(some), hashed_rows([t for t, _ in counts[some:]]), [ROWS - 1]])
    inside = np.full((GROUPS, MEMBERS), -30.0)  # places without a token
    inside.ravel()[:some] = np.log(freq[:some])
    top = inside.max(axis=1, keepdims=True)
    inside -= top + np.log(np.exp(inside - top).sum(axis=1, keepdims=True))
    prior = np.log((mass + 0.5) / (mass.sum() + 0.5 * CLASSES))
    lexicon = Lexicon({t: i for i, (t, _) in enumerate(counts)}, classes, members, rows, share, int(freq[-1]) if n else 0, float(np.log(max(1.0, mass[CLASSES - 1]))))
    return lexicon, prior, inside


#: Logits of a smaller size than this have exponentials and sums of them that 32 bits hold.
_SAFE = 60.0


def _exp(z: np.ndarray, at: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In place: exponentials of the rows up to a factor. With it the rows' sums, and of each row the logarithm of the share of column ``at``. bound: no logit is larger in size."""
    if bound > _SAFE:
        z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    sums = z @ np.ones(z.shape[1], z.dtype)
    return z, sums, own - np.log(sums)


def _bound(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest size of h @ w + b for any h within -1 and 1; of each matrix if there are several."""
    return (np.abs(w).sum(axis=-2) + np.abs(b)).max(axis=-1)


def _errors(z: np.ndarray, at: np.ndarray, bound: float) -> np.ndarray:
    """In place: probabilities of the rows, less 1 in column ``at``."""
    z, sums, _ = _exp(z, at, bound)
    z /= sums[:, None]
    z[np.arange(len(z)), at] -= 1
    return z


@dataclass
class Network:
    """embed: (offsets, rows, width); bias: (width,); out: (width, classes); prior: (classes,); inner: (groups, width, members); inside: (groups, members)."""

    embed: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    prior: np.ndarray
    inner: np.ndarray
    inside: np.ndarray

    @classmethod
    def start(cls, prior: np.ndarray, inside: np.ndarray, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        small = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
        return cls(small(len(OFFSETS), ROWS, WIDTH), np.zeros(WIDTH, np.float32), small(WIDTH, CLASSES), prior.astype(np.float32), small(GROUPS, WIDTH, MEMBERS), inside.astype(np.float32))

    def _parts(self) -> tuple[np.ndarray, ...]:
        return self.embed, self.bias, self.out, self.prior, self.inner, self.inside

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self._parts()])

    def unflat(self, w: np.ndarray) -> Network:
        at, parts = 0, []
        for x in self._parts():
            parts.append(w[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*parts)

    def hidden(self, windows: np.ndarray) -> np.ndarray:
        h = self.embed[0].take(windows[:, 0], axis=0)
        for k in range(1, len(OFFSETS)):
            h += self.embed[k].take(windows[:, k], axis=0)
        h += self.bias
        return np.tanh(h, out=h)

    @staticmethod
    def _by_class(windows: np.ndarray, classes: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """The order of the classes, the three in it, and each group that occurs with its stretch."""
        order = np.argsort(classes.astype(np.uint8), kind="stable")  # 8 bits sort faster
        classes = classes[order]
        ends = np.searchsorted(classes, np.arange(GROUPS + 1)).tolist()
        return order, windows[order], classes, members[order], [(g, slice(ends[g], ends[g + 1])) for g in range(GROUPS) if ends[g + 1] > ends[g]]

    def log_probs(self, windows: np.ndarray, classes: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Of the classes, and in groups of the members too."""
        order, windows, classes, members, groups = self._by_class(windows, classes, members)
        h = self.hidden(windows)
        got = _exp(h @ self.out + self.prior, classes, _bound(self.out, self.prior))[2].astype(float)
        bounds = _bound(self.inner, self.inside)
        for g, at in groups:
            got[at] += _exp(h[at] @ self.inner[g] + self.inside[g], members[at], bounds[g])[2]
        out = np.empty_like(got)
        out[order] = got
        return out

    def step(self, windows: np.ndarray, classes: np.ndarray, members: np.ndarray, rate: float) -> None:
        _, windows, classes, members, groups = self._by_class(windows, classes, members)
        h, n = self.hidden(windows), len(classes)
        p = _errors(h @ self.out + self.prior, classes, _bound(self.out, self.prior))
        back = p @ self.out.T
        bounds = _bound(self.inner, self.inside)
        for g, at in groups:
            x = h[at]
            q = _errors(x @ self.inner[g] + self.inside[g], members[at], bounds[g])
            back[at] += q @ self.inner[g].T
            by = np.float32(rate / max(len(x), 32))
            self.inner[g] -= by * (x.T @ q)
            self.inside[g] -= by * (np.ones(len(x), np.float32) @ q)
        all_rows = np.ones(n, np.float32)
        self.out -= np.float32(rate / n) * (h.T @ p)
        self.prior -= np.float32(rate / n) * (all_rows @ p)
        back *= 1 - h * h
        self.bias -= np.float32(rate / n) * (all_rows @ back)
        # Each row moves by its own windows' sum over the root of their number, so that rare tokens move as frequent ones do; all offsets in one sort.
        keys = (windows + np.arange(len(OFFSETS)) * ROWS).astype(np.uint16).ravel()  # 16 bits sort faster
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(back.take(order // len(OFFSETS), axis=0), first, axis=0)
        by = (rate / np.sqrt(np.diff(np.append(first, len(keys))))).astype(np.float32)
        self.embed.reshape(-1, WIDTH)[keys[first]] -= by[:, None] * sums


def score_texts(texts: list[str], lexicon: Lexicon, net: Network) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """For each text: its number of tokens, the sum of its tokens' conditional log-probabilities short of the
    shares of unknown ones in their class, and these tokens."""
    b = lexicon.batch(texts)
    each = b.share.copy()
    for i in range(0, len(each), SCORE_ROWS):
        each[i : i + SCORE_ROWS] += net.log_probs(b.windows[i : i + SCORE_ROWS], b.classes[i : i + SCORE_ROWS], b.members[i : i + SCORE_ROWS])
    ends = np.cumsum(b.lengths)
    sums = np.concatenate([[0.0], np.cumsum(each)])
    total = sums[ends] - sums[ends - b.lengths]
    cut = np.searchsorted(b.rare_at, np.concatenate([[0], ends]))
    return b.lengths, total, [b.rare[a:z] for a, z in zip(cut, cut[1:], strict=False)]


def token_counts(docs: DataFrame) -> DataFrame:
    """token (binary), n over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.binary()), pa.array(list(seen.values()), type=pa.int64())], schema=schema)

        for batch in batches:
            for part in slices(batch, 0):
                for t in part.column(0).to_pylist():
                    seen.update(tokens_of(t))
                if len(seen) > 200_000:  # counts handed on so far are added up later
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    made = docs.select(empty_text().alias("text")).mapInArrow(count, "token binary, n long")
    return made.groupBy("token").agg(F.sum("n").alias("n"))


def _train_tasks(docs: DataFrame, shared, rate: float) -> DataFrame:
    """block, lot, n, w: each task's weights after its own windows, cut into blocks, with its number of windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lexicon, first = shared.value
        net = first.unflat(first.flat())
        trained = 0
        for batch in batches:
            for part in slices(batch, 0):
                b = lexicon.batch(part.column(0).to_pylist())
                for i in range(0, len(b.classes), STEP_ROWS):
                    net.step(b.windows[i : i + STEP_ROWS], b.classes[i : i + STEP_ROWS], b.members[i : i + STEP_ROWS], rate)
                trained += len(b.classes)
        if trained:
            w, lot = net.flat(), TaskContext.get().partitionId() % LOTS
            for k in range(0, len(w), BLOCK):
                yield _block(k // BLOCK, lot, float(trained), w[k : k + BLOCK])

    return docs.select(empty_text().alias("text")).mapInArrow(work, "block long, lot long, n double, w binary")


def _block(block: int, lot: int, n: float, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([lot]), pa.array([n]), pa.array([w.astype(np.float32).tobytes()], type=pa.binary())], names=["block", "lot", "n", "w"])


def _average(rows: DataFrame) -> DataFrame:
    """One row for each block: means weighted by n, first inside the lots, then over them. A task adds up what comes to it as it streams by."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, x = None, 0.0, None
        for batch in batches:
            for block, lot, m, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (block, lot):
                    if key is not None:
                        yield _block(*key, n, x / n)
                    key, n, x = (block, lot), 0.0, 0.0
                n += m
                x = x + np.frombuffer(w, dtype=np.float32).astype(float) * m
        if key is not None:
            yield _block(*key, n, x / n)

    schema = "block long, lot long, n double, w binary"
    for _ in range(2):
        rows = rows.repartition("block", "lot").sortWithinPartitions("block", "lot", "n", "w").mapInArrow(work, schema).withColumn("lot", F.lit(0).cast("long"))
    return rows


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Lexicon, Network, DataFrame]:
    """Lexicon, network and token counts for the corpus ``docs`` (text).

    What reaches the driver are the known tokens, some roots of the distinct ones, and one network.
    """
    spark = docs.sparkSession
    counts = materialize(token_counts(docs), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    known = PREDICTED + KNOWN_PER_ROOT * int(np.ceil(np.sqrt(distinct)))
    # Steps of a twelfth or less between counts say which tokens can be among the most frequent; the others aren't sorted.
    step = F.floor(8 * F.log2("n"))
    above, least = 0, 0
    for s, k in sorted(((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True):  # at most 512 rows
        above, least = above + k, s
        if above >= known:
            break
    top = counts.where(step >= least).orderBy(F.desc("n"), "token").limit(known).toArrow()
    pairs = sorted(zip(top["token"].to_pylist(), top["n"].to_pylist(), strict=True), key=lambda p: (-p[1], p[0]))
    lexicon, prior, inside = build_lexicon(pairs, total)
    net = Network.start(prior, inside)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((lexicon, net))
        got = _average(_train_tasks(docs, shared, STEP / (1 + r))).toArrow()
        blocks = dict(zip(got["block"].to_pylist(), got["w"].to_pylist(), strict=True))
        if blocks:
            net = net.unflat(np.concatenate([np.frombuffer(blocks[k], dtype=np.float32) for k in sorted(blocks)]))
    return lexicon, net, counts


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over all tokens), mean_log_prob for every row of ``docs`` (doc_id, text).

    The model is trained on the same documents. A text without tokens (null, empty, white space) has
    log_prob 0 and a null mean; repeated rows are scored and counted each; texts of any length are scored
    whole; an empty table gives no rows; other columns are ignored. Weights depend on how rows are dealt to
    tasks; for the same files and settings they agree from run to run, up to rounding.
    """
    spark = docs.sparkSession
    lexicon, net, counts = train(docs, rounds)
    shared = spark.sparkContext.broadcast((lexicon, net))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, net = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                n, total, rare = score_texts(part.column(1).to_pylist(), lexicon, net)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(total), pa.array(rare, type=pa.list_(pa.binary()))], names=["doc_id", "n_tokens", "log_prob", "rare"])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", empty_text().alias("_text")).mapInArrow(work, f"doc_id {kind}, n_tokens long, log_prob double, rare array<binary>")
    scored = materialize(made.withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    # The counts of unknown tokens; none of these is frequent, so no key is hot.
    used = scored.select("_row", F.explode("rare").alias("token")).join(counts.where(F.col("n") <= lexicon.least), "token", "left")
    shares = used.groupBy("_row").agg(F.sum(F.log(F.coalesce("n", F.lit(0.5))) - lexicon.rest).alias("_share"))
    rows = scored.drop("rare").join(shares, "_row", "left")
    log_prob = F.col("log_prob") + F.coalesce("_share", F.lit(0.0))
    return rows.select("doc_id", "n_tokens", log_prob.alias("log_prob"), F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens")).alias("mean_log_prob"))
