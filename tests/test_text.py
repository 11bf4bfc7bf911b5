"""Folding, tokenising, stemming and edit distance."""

import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.functions import tokens as tk
from quillstack.functions.fuzzy import osa_distance
from quillstack.operators import index


def column(spark, values, f, name="x"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col(name)).alias("y")).collect()]


def test_fold(spark):
    words = ["Résumé", "don't", "İstanbul", "Ångström", "naïve’s", "Ünïcödé", "ЙОГУРТ", "K elvin", "plain", "ẞ", "ἄνθρωπος", "한글", "がぎ"]
    assert [tx.fold_text(w) for w in words[:4]] == ["resume", "dont", "istanbul", "angstrom"]
    odd = column(spark, words, tx.folds_oddly)
    assert odd == [False] * 11 + [True] * 2
    assert column(spark, words[:11], tx.fold) == [tx.fold_text(w) for w in words[:11]]
    assert column(spark, words, tx.fold_udf) == [tx.fold_text(w) for w in words]


def test_fold_agrees_on_every_letter_below_the_oddities(spark):
    letters = [chr(c) for c in range(0x20, 0x3000) if unicodedata.category(chr(c))[0] in "LN"]
    odd = column(spark, letters, tx.folds_oddly)
    native = column(spark, letters, tx.fold)
    assert [(c, n) for c, n, o in zip(letters, native, odd, strict=True) if not o and n != tx.fold_text(c)] == []


COMPOUNDS = {"getUserId": ["get", "User", "Id"], "HTTPServer": ["HTTP", "Server"], "mp3player": ["mp", "3", "player"], "snake_case": ["snake", "case"], "plain": [], "Word": [], "don't": ["don", "t"], "2026": [], "a1b2": ["a", "1", "b", "2"], "ABc": ["A", "Bc"], "x__y": ["x", "y"]}


def test_compounds(spark):
    assert column(spark, COMPOUNDS, tx.compound_parts) == list(COMPOUNDS.values())
    assert [[w[a:b] for a, b in tk.compound_spans(w)] for w in COMPOUNDS] == list(COMPOUNDS.values())


def test_native_and_row_tokenisers_agree(spark):
    r = random.Random(1)
    texts = ["".join(r.choices("aBcD1_'’é -.日Й", k=60)) for _ in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.explode(tx.raw_words(F.col("t"))).alias("w"))
    rows = rows.select("i", F.explode(F.concat(F.array("w"), tx.compound_parts(F.col("w")))).alias("x")).select("i", tx.fold("x").alias("x"))
    found: dict[int, list] = {}
    for i, x in rows.collect():
        found.setdefault(i, []).append(x)
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(x[0] for x in tk.tokenize(t)) for i, t in enumerate(texts) if tk.tokenize(t)}


STEMS = {"running": "run", "runs": "run", "cities": "city", "boxes": "box", "classes": "class", "houses": "hous", "is": "is", "bus": "bus", "glass": "glass", "making": "mak", "creating": "create", "stopped": "stop", "falling": "fall", "quickly": "quick", "statement": "state", "kindness": "kind", "tried": "tri", "loved": "love", "argued": "argue", "red": "red", "sing": "sing", "wishes": "wish"}


def test_stems(spark):
    assert dict(zip(STEMS, column(spark, STEMS, tx.stem), strict=True)) == STEMS


def test_offsets_point_at_the_words():
    text = "Ünïque getUserId it's"
    spans = [(text[a:b], f, p) for f, a, b, p in tk.tokenize(text)]
    assert spans == [("Ünïque", "unique", 0), ("getUserId", "getuserid", 1), ("get", "get", 1), ("User", "user", 1), ("Id", "id", 1), ("it's", "its", 2), ("it", "it", 2), ("s", "s", 2)]


def test_trigrams_and_budgets(spark):
    assert column(spark, ["ab", "aaa"], tx.trigrams) == [["  a", " ab", "ab "], ["  a", " aa", "aaa", "aa "]]
    assert column(spark, ["abc", "abcd", "abcdef"], tx.max_edits) == [0, 1, 2]


def plain_osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edit_distance_against_the_plain_recurrence():
    r = random.Random(2)
    for _ in range(20_000):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 7))) for _ in range(2))
        most = r.randint(0, 3)
        assert osa_distance(a, b, most) == min(plain_osa(a, b), most + 1)
    assert osa_distance("ca", "abc", 3) == 3 and osa_distance("form", "from", 1) == 1


def test_titles_previews_and_counts(spark):
    bodies = ["\n# Head **x**\n\n- [ ] task one\n> quoted\ntext [[A|b]] end", "- [x] done\nrest", "###", "", "  \n \n", "only", "[[Target|shown]] title", "a\n\n\nb\nc " + "w" * 300]
    titles = column(spark, bodies, lambda c: tx.derive_title(c, "Untitled"))
    assert titles == ["Head **x**", "done", "###", "Untitled", "Untitled", "only", "Target title", "a"]
    assert column(spark, bodies, tx.preview) == [tk.preview_text(b) for b in bodies]
    assert column(spark, bodies, tx.preview)[0] == "task one  quoted  text A end" and len(column(spark, bodies, tx.preview)[-1]) == 181
    assert column(spark, ["a b-c d'e ... 1", ""], tx.word_count) == [4, 0]
    assert [r[0] for r in spark.createDataFrame([(0,), (329,), (330,), (2200,)], "w int").select(tx.reading_minutes(F.col("w"))).collect()] == [1, 1, 2, 10]


def test_times_and_labels(spark):
    now = 1_787_788_800_000
    at = [now - 30_000, now - 12 * 60_000, now - 3 * 3_600_000, now - 2 * 86_400_000, now - 40 * 86_400_000, now - 400 * 86_400_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "i int, t long").orderBy("i").select(tx.relative_time(F.col("t"), now)).collect()
    assert [r[0] for r in rows] == ["now", "12m", "3h", "Tue", "18 Jul", "23 Jul 2025"]
    assert column(spark, ["short", " ", "a rather long title for a node"], tx.graph_label) == ["short", "Untitled", "a rather long…"]


@pytest.mark.parametrize("ranges", [[], [(0, 2)], [(1, 3), (5, 7)]])
def test_marked_segments(spark, ranges):
    df = spark.createDataFrame([("abcdefg", ranges)], "t string, r array<struct<start:int,end:int>>")
    parts = df.select(tx.marked_segments(F.col("t"), F.col("r"))).first()[0]
    assert "".join(p["text"] for p in parts) == "abcdefg" and [p["text"] for p in parts if p["marked"]] == ["abcdefg"[a:b] for a, b in ranges]


def test_snippets_keep_their_offsets():
    body = "Title line\n" + "filler words here " * 30 + "the **needle** in [[the hay|a stack]] . needle again " + "more filler " * 40
    text, ranges = tk.snippet(body, {"needle", "stack"})
    assert [text[a:b] for a, b in ranges] == ["needle", "stack", "needle"] and text.startswith("…") and text.endswith("…")
    assert "[[" not in text and "**" not in text and "stack." in text and len(text) < 260
    assert tk.snippet("one\ntwo", {"zzz"}) == ("two", [])
    assert tk.highlight_ranges("getUserId", {"getuserid", "get", "id"}) == [[0, 9]]


def test_index_tokens_are_those_of_the_row_tokeniser(spark):
    r = random.Random(1)
    letters = ["a", "B", "c", "D", "É", "é", "é", "ß", "Σ", "ς", "σ", "'", "’", "_", " ", "1", "22", "-", ".", "x", "YZ", "日", "が", "؀", "`", "K", "ﬁ", "İ", "ı"]
    texts = ["".join(r.choices(letters[: r.randint(6, len(letters))], k=r.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(str(i), "", t, []) for i, t in enumerate(texts)], "note_id string, title string, body string, tags array<string>")
    found = {i: Counter() for i in range(len(texts))}
    for row in index.tokens(df).collect():
        found[int(row["note_id"])][row["term"]] += 1
    for i, t in enumerate(texts):
        want = Counter()
        for word in tk._WORD.findall(t):
            word = word.rstrip("'’_")
            want.update([tx.fold_text(word), *(tx.fold_text(word[a:b]) for a, b in tk.compound_spans(word))])
        assert found[i] == Counter({k: n for k, n in want.items() if k})
