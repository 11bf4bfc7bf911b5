"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training takes a bounded sample of labelled rows, the ones with the least hash of their id, and is exact
beyond that: quantile bins, per-level histograms of gradients, logistic loss. The trees are flattened into
arrays (feature, threshold, children, value), and a batch of documents walks all of them at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.arrow_text import map_texts
from quillstack.llm.common import named

#: Most labelled rows that training takes.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 120, 4, 0.1, 64, 12, 1.0
THRESHOLD = 0.3

# Byte classes whose share of the text is a statistic.
CLASSES = {
    "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "space": b" \t", "line": b"\n\r",
    "stop": b".", "comma": b",;:", "mark": b"!?", "quote": b"'\"`", "bracket": b"()[]{}<>", "slash": b"/\\", "pipe": b"|", "star": b"*",
    "sign": b"#$%&@^~+=_", "dash": b"-", "high": bytes(range(128, 256)), "control": bytes(x for x in range(32) if x not in (9, 10, 13)),
}
FEATURES = [*CLASSES, "log_bytes", "log_words", "word_bytes", "word_spread", "short_words", "long_words", "distinct_words", "top_word", "log_lines", "line_bytes", "distinct_lines", "line_spread", "entropy", "marked_words", "capital_words", "caps_words", "digit_words"]
_CLASS = np.zeros((256, len(CLASSES)))
for _k, _members in enumerate(CLASSES.values()):
    _CLASS[list(_members), _k] = 1.0
_WORDLIKE = np.zeros(256, dtype=bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def statistics(text: str) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    data = text.encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    n = max(1, len(raw))
    hist = np.bincount(raw, minlength=256)
    share = hist / n
    seen = share[share > 0]
    words, lines = data.split(), data.split(b"\n")
    nw, nl = max(1, len(words)), len(lines)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    widths = np.fromiter(map(len, lines), dtype=np.int64, count=nl)
    # Words' first and last bytes, from where blanks and other bytes meet.
    blank = np.concatenate(([True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]))
    first = np.flatnonzero(blank[:-1] & ~blank[1:])
    last = np.flatnonzero(~blank[:-1] & blank[1:]) - 1
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    if len(first):
        heads, ends = raw[first], raw[last]
        second = raw[np.minimum(first + 1, last)]
        marked = float((~_WORDLIKE[ends]).mean())
        capital = float(_UPPER[heads].mean())
        caps = float((_UPPER[heads] & _UPPER[second] & (last > first)).mean())
        digits = float(((heads >= 48) & (heads <= 57)).mean())
    else:
        marked = capital = caps = digits = 0.0
    return [
        *(share @ _CLASS).tolist(), float(np.log1p(len(raw))), float(np.log1p(len(words))), float(sizes.mean()), float(sizes.std()),
        float((sizes <= 3).mean()), float((sizes > 12).mean()), len(counts) / nw, max(counts.values(), default=0) / nw, float(np.log1p(nl)),
        float(widths.mean()), len(set(lines)) / nl, float(widths.std()), float(-(seen * np.log2(seen)).sum()) if len(seen) else 0.0, marked, capital, caps, digits,
    ]


@dataclass
class Forest:
    """Flat trees: node k of all trees tests column feature[k] <= threshold[k]; feature -1 marks a leaf."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """Boosted trees for labels 0 and 1. Without rows the score is 0.5; with one label it is near that label."""
    n = len(y)
    rate_of_ones = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        raw = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([-1, 0.0, 0, 0, 0.0])
            ids = [len(nodes) - 1]  # of the open nodes, by their number in the level
            level = np.zeros(n, dtype=np.int64)  # a row's open node; -1 once it is in a leaf
            at = np.full(n, ids[0])
            for d in range(depth + 1):
                k, open_ = len(ids), level >= 0
                lv = level[open_]
                gs, hs = (np.bincount(lv, weights=w[open_], minlength=k) for w in (g, h))
                best = [(1e-6, -1, 0)] * k
                if d < depth:
                    for f in range(x.shape[1]):
                        key = lv * bins + binned[open_, f]
                        G, H, N = (np.bincount(key, weights=w, minlength=k * bins).reshape(k, bins).cumsum(axis=1) for w in (g[open_], h[open_], np.ones(len(lv))))
                        ok = (N >= LEAST_ROWS) & (N[:, -1:] - N >= LEAST_ROWS)
                        gain = G**2 / (H + RIDGE) + (gs[:, None] - G) ** 2 / (hs[:, None] - H + RIDGE) - (gs**2 / (hs + RIDGE))[:, None]
                        gain = np.where(ok, gain, -1.0)
                        cut = gain.argmax(axis=1)
                        for i in range(k):
                            if gain[i, cut[i]] > best[i][0] and cut[i] < len(edges[f]):
                                best[i] = (gain[i, cut[i]], f, int(cut[i]))
                nxt, move = [], np.full(k, -1)
                for i, node in enumerate(ids):
                    _, f, c = best[i]
                    if f < 0:
                        nodes[node][4] = float(-rate * gs[i] / (hs[i] + RIDGE))
                        continue
                    nodes[node][:4] = [f, float(edges[f][c]), len(nodes), len(nodes) + 1]
                    nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
                    move[i] = len(nxt)
                    nxt += [len(nodes) - 2, len(nodes) - 1]
                if not nxt:
                    break
                rows = np.flatnonzero(open_)
                moved = move[level[rows]]
                f_of, c_of = np.array([b[1] for b in best]), np.array([b[2] for b in best])
                go = binned[rows, np.maximum(f_of[level[rows]], 0)] > c_of[level[rows]]
                level[rows] = np.where(moved < 0, -1, moved + go)
                inside = rows[moved >= 0]
                at[inside] = np.array(nxt)[level[inside]]
                ids = nxt
            raw = raw + np.array([v[4] for v in nodes])[at]
    flat = np.array(nodes, dtype=float).reshape(-1, 5)
    return Forest(base, np.array(roots, dtype=np.int64), flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], depth)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of all ids that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Trees from the labelled rows of ``docs`` outside the held-out fifth.

    labels: doc_id, quality; of several labels of an id the largest counts; other values than 0 and 1 and nulls are passed over.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("_label"))
    usable = usable.groupBy("doc_id").agg(F.max("_label").alias("_label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample_rows at most
    made = map_texts(rows, "x array<double>", lambda: lambda texts: [[statistics(t) for t in texts]], keys=("doc_id", "_label"))
    # A doc_id that repeats adds rows beyond the sample: the first by value of each id stands for it.
    got = made.groupBy("doc_id").agg(F.min(F.struct("_label", "x")).alias("r")).select("doc_id", "r.*").toArrow()
    ids = np.array(got["doc_id"].to_pylist(), dtype=np.int64)
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(len(ids), len(FEATURES))
    y = np.array(got["_label"].to_pylist(), dtype=float)
    order = np.argsort(ids)
    return fit(x[order], y[order])


def quality_scores(docs: DataFrame, forest: Forest, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and score, the probability of label 1, for every row of ``docs``. A null text is scored as the empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # bounded by TREES and DEPTH

    def make():
        f = shared.value
        return lambda texts: [f.scores(np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))).tolist()]

    return map_texts(docs, "score double", make, keys)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Scores come from the text alone. A null doc_id is scored like any other and isn't held out; repeated
    rows give repeated rows; an empty table gives none; without usable labels every score is 0.5; other
    columns are ignored.
    """
    scored = quality_scores(docs, train(docs, labels, sample_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, in the same columns.

    Null and empty texts are scored as the empty one; texts of any length are read whole; repeated rows and
    rows without a doc_id are judged each by their text; without usable labels every row stays; an empty
    table gives none; columns may have any names.
    """
    scored = quality_scores(docs.select(*[named(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.col("text")), train(docs, labels, sample_rows), tuple(f"_c{i}" for i in range(len(docs.columns))))
    return scored.where(F.col("score") >= THRESHOLD).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
