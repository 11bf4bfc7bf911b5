"""The quality classifier's statistics and trees against plain versions of their definitions."""

import math
import random
import string

import numpy as np
import pytest

from quillstack.llm import quality


def plain_statistics(text):
    data = text.encode()
    n = max(1, len(data))
    words = [w for w in "".join(chr(b) if b not in (9, 10, 11, 12, 13) else " " for b in data).split(" ") if w]
    lines = [""]
    for b in data:
        if b == 10:
            lines.append("")
        else:
            lines[-1] += chr(b)
    sizes = [len(w) for w in words] or [0]
    widths = [len(x) for x in lines]
    spread = lambda v: math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v))
    part = lambda rule, of: sum(map(rule, of)) / len(of) if of else 0.0
    wordlike = lambda c: c in string.ascii_letters + string.digits or ord(c) >= 128
    upper = lambda c: c in string.ascii_uppercase
    out = {k: sum(b in members for b in data) / n for k, members in quality.CLASSES.items()}
    out |= {"log_bytes": math.log(1 + len(data)), "log_words": math.log(1 + len(words)), "word_bytes": sum(sizes) / len(sizes), "word_spread": spread(sizes)}
    out |= {"short_words": part(lambda s: s <= 3, sizes), "long_words": part(lambda s: s > 12, sizes), "distinct_words": len(set(words)) / max(1, len(words))}
    out |= {"top_word": max((words.count(w) for w in set(words)), default=0) / max(1, len(words)), "log_lines": math.log(1 + len(lines)), "line_bytes": sum(widths) / len(widths)}
    out |= {"distinct_lines": len(set(lines)) / len(lines), "line_spread": spread(widths)}
    out["entropy"] = -sum(c / n * math.log2(c / n) for c in (data.count(b) for b in set(data)))
    out |= {"marked_words": part(lambda w: not wordlike(w[-1]), words), "capital_words": part(lambda w: upper(w[0]), words)}
    out |= {"caps_words": part(lambda w: len(w) > 1 and upper(w[0]) and upper(w[1]), words), "digit_words": part(lambda w: w[0] in string.digits, words)}
    return [out[k] for k in quality.FEATURES]


def test_statistics_are_their_definitions():
    r = random.Random(7)
    letters = "abcXYZ019 .,;:!?'\"()/|*#-_é日\t\n\r"
    texts = ["", " ", "\n", "A", "AB c1 2d E.", "one\n\ntwo two\n"] + ["".join(r.choices(letters, k=r.randint(1, 300))) for _ in range(200)]
    for t in texts:
        assert quality.statistics(t) == pytest.approx(plain_statistics(t), abs=1e-9)


def plain_boosting(x, y, trees, depth, bins):
    """Every split of every node tried in turn."""
    n = len(y)
    rate = (sum(y) + 0.5) / (n + 1)
    raw = [math.log(rate / (1 - rate))] * n
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for f in range(x.shape[1])]

    def grow(rows, d, g, h, out):
        G, H, best = sum(g[i] for i in rows), sum(h[i] for i in rows), (1e-6, None)
        for f in range(x.shape[1]) if d < depth else ():
            of_feature = (-1.0, None)
            for e in edges[f]:
                left = [i for i in rows if x[i, f] <= e]
                if len(left) < quality.LEAST_ROWS or len(rows) - len(left) < quality.LEAST_ROWS:
                    continue
                a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                gain = a * a / (b + quality.RIDGE) + (G - a) ** 2 / (H - b + quality.RIDGE) - G * G / (H + quality.RIDGE)
                if gain > of_feature[0] + 1e-12:
                    of_feature = (gain, (f, e))
            if of_feature[0] > best[0] + 1e-12:
                best = of_feature
        if best[1] is None:
            for i in rows:
                out[i] = -quality.RATE * G / (H + quality.RIDGE)
            return
        f, e = best[1]
        grow([i for i in rows if x[i, f] <= e], d + 1, g, h, out)
        grow([i for i in rows if x[i, f] > e], d + 1, g, h, out)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in raw]
        step = [0.0] * n
        grow(list(range(n)), 0, [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p], step)
        raw = [a + b for a, b in zip(raw, step, strict=True)]
    return [1 / (1 + math.exp(-v)) for v in raw]


@pytest.mark.parametrize("seed", range(4))
def test_trees_take_the_best_of_all_splits(seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(150, 3)).round(2)
    y = ((x[:, 0] + 0.5 * x[:, 1] * (seed % 2) + 0.3 * r.normal(size=150)) > 0).astype(float)
    forest = quality.fit(x, y, trees=4, depth=3, bins=16)
    assert forest.scores(x) == pytest.approx(plain_boosting(x, y, 4, 3, 16), abs=1e-9)
