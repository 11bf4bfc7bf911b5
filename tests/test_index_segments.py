"""The index that follows edits, and the tables of words, against what a rebuild gives."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.operators import dictionary as di
from quillstack.operators import expand as ex
from quillstack.operators import index as ix
from quillstack.operators import segments as sg
from quillstack.operators.history import with_derived
from quillstack.plans.search import search
from quillstack.schema import NOTE
from quillstack.streaming import edits as st

NOW = 1_787_788_800_000
WORDS = ["river", "rivers", "lake", "lakeside", "stone", "stony", "bridge", "bridging", "moss", "café", "getUserId", "don't", "naïve", "weir"]


def note(r, i, now):
    title = r.choice(["Alpha", "Beta", "Gamma", "Delta", f"Note {i}", ""])
    links = "".join(f" [[{r.choice(['alpha', 'Beta', 'GAMMA', 'Delta', 'nowhere', f'note {r.randrange(8)}'])}]]" for _ in range(r.randrange(4)))
    body = " ".join(r.choices(WORDS, k=r.randrange(12))) + links + r.choice(["", " #a/b", " #c"])
    return {"note_id": f"n{i}", "title": title, "body": body, "created_at": now, "updated_at": now + r.randrange(5), "tags": [], "links": [], "pinned": i % 5 == 0, "archived": False, "locked": False, "trashed_at": now if r.random() < 0.15 else None, "rev": 1}


def frame(spark, notes):
    return with_derived(spark.createDataFrame(list(notes), NOTE)).select(NOTE.names)


def shown(rows):
    return sorted(str(sorted(r.asDict().items())) for r in rows.collect())


def check_equal(kept, notes):
    built = ix.build_index(notes)
    assert shown(kept.postings.join(kept.docs.select(kept.key), kept.key).select(built.postings.columns)) == shown(built.postings)
    assert shown(kept.docs.select(built.docs.columns)) == shown(built.docs)
    assert shown(kept.vocab) == shown(built.vocab)
    assert shown(kept.stats) == shown(built.stats)
    live = kept.vocab.select("term")
    assert shown(kept.words.grams.join(live, "term", "left_semi").select("gram", "size", "term")) == shown(built.words.grams)
    assert shown(kept.words.stems.join(live, "term", "left_semi").select("stem", "term")) == shown(built.words.stems)


@pytest.mark.parametrize("seed", [1, 2])
def test_edits_and_deletions_give_what_a_rebuild_gives(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(sg, "RATIO", 0 if seed == 1 else 1)  # every batch stays a segment of its own, or some are merged
    r, now = random.Random(seed), {}
    index = sg.SegmentedIndex(spark, str(tmp_path))
    for batch in range(3):
        some = {i: note(r, i, 1000 * (batch + 1)) for i in (range(10) if batch == 0 else r.sample(range(13), 3))}
        gone = set() if batch == 0 else set(r.sample(range(14), 2))
        now = {i: n for i, n in (now | some).items() if i not in gone}
        ids = spark.createDataFrame([(f"n{i}",) for i in sorted(gone)], "note_id string")
        index.apply(frame(spark, some.values()), ids, batch)
    index.apply(frame(spark, some.values()), ids, batch)  # a replay
    notes = frame(spark, now.values())
    check_equal(index.read(), notes)
    assert (len(index.manifest().segments) == 3) == (seed == 1)
    asked = [("a", "river stny"), ("b", "is:linked bridge"), ("c", "lakesid moss"), ("d", "tag:a -café ston")]
    want = search(ix.build_index(notes), notes, asked, NOW).withColumn("score", F.round("score", 9))
    assert shown(search(index.read(), notes, asked, NOW).withColumn("score", F.round("score", 9))) == shown(want)
    if seed == 1:
        index.merge(1)
        check_equal(index.read(), notes)
    index.merge()
    check_equal(index.read(), notes)
    assert len(index.manifest().segments) == 1
    index.clean()
    check_equal(index.read(), notes)


def test_a_batch_writes_its_own_notes_and_a_broken_one_is_not_read(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    first = [note(r, i, 1000) for i in range(40)]
    index = sg.SegmentedIndex(spark, str(tmp_path))
    index.apply(frame(spark, first), batch=0)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    changed = [note(r, 7, 2000), note(r, 41, 2000)]

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(sg.SegmentedIndex, "_put_manifest", broken)
        with pytest.raises(OSError):
            index.apply(frame(spark, changed), batch=1)
    check_equal(index.read(), frame(spark, first))
    index.apply(frame(spark, changed), batch=1)
    check_equal(index.read(), frame(spark, [*(n for n in first if n["note_id"] != "n7"), *changed]))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # nothing of the first segment was written again
    last = index.manifest().segments[-1]
    rows = {t: spark.read.schema(sg.TABLES[t]).parquet(f"{tmp_path}/{last.name}/{t}") for t in ("docs", "postings")}
    assert {x["note_id"] for t in rows.values() for x in t.select("note_id").collect()} <= {"n7", "n41"}
    lost = index.manifest()
    index._put_manifest(2, lost.segments, lost)
    with pytest.raises(RuntimeError):  # two writers that started from the same manifest
        index._put_manifest(2, lost.segments, lost)


def test_a_stream_of_edits_and_deletions_can_be_searched(spark, tmp_path):
    r = random.Random(5)
    src, out, cp = (str(tmp_path / x) for x in ("src", "index", "cp"))
    schema = T.StructType([*NOTE.fields, T.StructField("deleted", T.BooleanType())])
    batches = [[{**note(r, i, 1000), "deleted": False} for i in range(6)], [{**note(r, 2, 2000), "deleted": False}, {**note(r, 2, 3000), "deleted": False, "body": "weir weir"}, {**note(r, 4, 2000), "deleted": True}]]
    for rows in batches:
        made = with_derived(spark.createDataFrame(rows, schema)).select(schema.names)
        made.coalesce(1).write.mode("append").parquet(src)
        st.maintain_index(spark.readStream.schema(schema).parquet(src), out, cp).awaitTermination()
    final = {n["note_id"]: n for rows in batches for n in rows}
    notes = frame(spark, [{k: v for k, v in n.items() if k != "deleted"} for n in final.values() if not n["deleted"]])
    index = sg.SegmentedIndex(spark, out).read()
    check_equal(index, notes)
    assert notes.count() == 5 and search(index, notes, [("q", "weir")], NOW).first()["note_id"] == "n2"


# ---- words ---------------------------------------------------------------------------------------


def test_intervals_hold_what_they_should(spark):
    assert di.prefix_end("ab") == "ac" and di.prefix_end("a\U0010ffff") == "b" and di.prefix_end("\U0010ffff") is None and di.prefix_end("퟿") == ""
    r = random.Random(2)
    terms = sorted({"".join(r.choices("abcé日\U0001f600", k=r.randint(1, 5))) for _ in range(400)})
    df = spark.createDataFrame([(t,) for t in terms], "term string").coalesce(1).cache()
    for n, most in ((1, 64), (20, 64), (60, 5), (60, 1)):
        prefixes = r.sample(terms, n)
        met = {x["term"] for x in df.where(di.starting_with(F.col("term"), prefixes, most)).collect()}
        exact = {t for t in terms if any(t.startswith(p) for p in prefixes)}
        assert exact <= met and (most < 64 or met == exact)
        some = {x["term"] for x in df.where(di.equal_to_some(F.col("term"), prefixes, most)).collect()}
        assert set(prefixes) <= some and (most < 64 or some == set(prefixes))


def test_expansion_is_the_same_with_and_without_words_at_hand(spark):
    r = random.Random(9)
    letters = "aeioustrnl"
    vocab = spark.createDataFrame([(t, 1) for t in sorted({"".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(3000)})], "term string, df long")
    words = di.Words.of(vocab.withColumn("stem", ix.tx.stem(F.col("term"))))
    terms = [*(x["term"] for x in vocab.limit(5).collect()), "s", "st", "str", "strn", "aeious", "satesr", "tsrea", "lo", "noise", "nosie", "running"]
    asked = spark.createDataFrame([("q", i, t, terms[i + 1] if i + 1 < len(terms) else None) for i, t in enumerate(terms)], "query_id string, i int, term string, next string")
    assert shown(ex.expand(asked, words, sorted(set(terms)))) == shown(ex.expand(asked, words))


def test_a_prefix_reads_the_part_of_the_dictionary_that_it_needs(spark, tmp_path):
    vocab = spark.range(400_000).select(F.lower(F.hex(F.xxhash64("id"))).alias("term"), F.lit(1).cast("long").alias("df")).withColumn("stem", F.col("term"))
    di.write_sorted(vocab, f"{tmp_path}/v", "term")
    found = spark.read.parquet(f"{tmp_path}/v").where(di.starting_with(F.col("term"), ["abcde", "ab1"]))
    plan = found._jdf.queryExecution().executedPlan()
    assert "GreaterThanOrEqual(term,ab1)" in plan.toString()
    assert len(found.collect()) < 200
    while plan.children().size():
        plan = plan.children().apply(0)
    assert 0 < plan.metrics().apply("numOutputRows").value() < 60_000  # rows that the scan handed on
