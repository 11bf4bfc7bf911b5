"""Awkward documents for the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names are those the operators use for their own.
CLASH = ["size", "hash", "shard", "kept", "row", "fp", "score", "taken", "target", "_range", "block", "_n", "_source", "_times", "_copy", "_row", "_s", "_d", "_at", "_p", "_text", "_parts", "bucket", "salt", "slot", "_doc_id", "ids", "a.b", "back`tick", "_key", "_row.c1"]


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    """Documents with copies, near copies, nulls in any column, empty, blank and long texts."""
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "naïve", "日本", "x1", "Foo_bar", "it's", "...", "the"]
    out = []
    for i in range(n):
        t = " ".join(r.choices(words, k=r.randint(1, 80)))
        out.append((i, t, r.choice(["en", "de"]), "hot" if i % 3 else f"s{i % 4}", len(t)))
    long = " ".join(r.choices(words, k=30_000))
    base = out[3][1]
    out += [(100, base, "en", "hot", 1), (101, base, None, None, None), (102, base + " tail", "en", "s1", 2), (103, long, "en", "hot", 3), (104, long + " z", "en", None, 4)]
    out += [(105, None, "en", "hot", None), (106, "", None, "s2", 0), (107, " \t\n", "en", "s2", 3), (108, "", "en", "hot", 0), (None, "no id here at all", "en", "hot", 5), (None, None, None, None, None)]
    out += [(110, "twice the same row", "en", "hot", 6)] * 2
    return out
