"""Files, version logs, lifecycle and streaming."""

import random

from pyspark.sql import functions as F

from quillstack.operators import history
from quillstack.operators.index import postings
from quillstack.operators.listing_rules import placed
from quillstack.operators.segments import SegmentedIndex
from quillstack.schema import NOTE, VERSION, empty_note, new_id
from quillstack.sources import notes as nt
from quillstack.streaming import edits as st

DAY = 86_400_000


def note(i, **f):
    return {**empty_note(i, 1000), **f}


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), NOTE)


def test_roundtrip_with_awkward_text(spark):
    rows = [note("a", title="T: with colon\nand line", body="---\nnot a header\n---\n#tag [[L]]", pinned=True, rev=7), note("b", title="", body=""), note("c", body="plain", trashed_at=5, archived=True, locked=True)]
    back = {r["note_id"]: r for r in nt.parse_notes(frame(spark, *rows).select(F.lit("f").alias("file_id"), nt.serialize().alias("raw"))).collect()}
    assert back["a"]["title"] == "T: with colon and line" and back["a"]["body"] == rows[0]["body"] and back["a"]["rev"] == 7 and back["a"]["tags"] == ["tag"] and back["a"]["links"] == ["l"]
    assert back["b"]["body"] == "" and back["c"]["trashed_at"] == 5 and back["c"]["archived"] and back["c"]["locked"] and not back["c"]["pinned"]


def test_leading_newline(spark):
    df = frame(spark, note("a", body="\nx"))
    read = lambda strict: nt.parse_notes(df.select(F.lit("f").alias("file_id"), nt.serialize(strict).alias("raw"))).first()["body"]
    assert read(False) == "x" and read(True) == "\nx"


def test_damaged_files(spark):
    raw = {"none": "no header", "open": "---\nid: x\nnever closed", "bad": "---\ntitle: ok\ncreated: soon\nrev: 3x\npinned: yes\ntrashed: 0\njunk\n: odd\n---\nbody", "twice": "---\nid: one\nid: two\ncreated: \n---\nb"}
    r = {x["file"]: x for x in nt.parse_notes(spark.createDataFrame(list(raw.items()), "file_id string, raw string"), 42).withColumn("file", F.col("note_id")).collect()}
    assert r["none"]["body"] == "no header" and r["open"]["body"] == raw["open"]
    assert r["bad"]["title"] == "ok" and r["bad"]["created_at"] == 42 and r["bad"]["updated_at"] == 42 and r["bad"]["rev"] == 1 and not r["bad"]["pinned"] and r["bad"]["trashed_at"] is None and r["bad"]["body"] == "body"
    assert r["two"]["created_at"] == 0


def test_files_and_logs_on_disk(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/good.md").write_text("---\nid: good\ntitle: G\n---\ntext")
    (tmp_path / "n/blank.md").write_text("  \n")
    (tmp_path / "n/lost.md").write_text("")
    (tmp_path / "n/old.md").write_text(f"---\nid: old\ntrashed: {DAY}\n---\nx")
    (tmp_path / "n/skip.txt").write_text("no")
    (tmp_path / "v").mkdir()
    (tmp_path / "v/blank.jsonl").write_text('{"rev":1,"at":5,"title":"t","body":"one"}\n\nnot json\n{"rev":2,"at":9,"title":"t","body":"two #x"}\n{"rev":2,"at":9,"ti')
    log = history.dedupe_versions(nt.read_version_log(spark, str(tmp_path / "v")))
    rows = {r["note_id"]: r for r in nt.load(nt.read_files(spark, str(tmp_path / "n")), log, 40 * DAY).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"good": "ok", "blank": "recovered", "lost": "unreadable", "old": "purged"}
    assert rows["blank"]["body"] == "two #x" and rows["blank"]["tags"] == ["x"] and rows["blank"]["created_at"] == 9 and rows["blank"]["rev"] == 2


def test_notes_written_as_files_are_read_again(spark, tmp_path):
    rows = [note("a", title="A", body="one\n#x/y [[b]]"), note("b b", body="", pinned=True), note("c", body="---\nid: z\n---\n", trashed_at=5)]
    folder = str(tmp_path / "w")
    for _ in range(2):  # written again, they take the place of the first ones
        assert nt.write_files(frame(spark, *rows), folder) == 3
    assert sorted(p.name for p in (tmp_path / "w").iterdir()) == ["a.md", "b b.md", "c.md"]
    back = {r["note_id"]: r for r in nt.load(nt.read_files(spark, folder), spark.createDataFrame([], VERSION), 40).collect()}
    assert set(back) == {"a", "b b", "c"} and all(back[r["note_id"]][k] == r[k] for r in rows for k in ("title", "body", "pinned", "trashed_at", "rev", "updated_at"))


def test_load_is_ordered_by_update(spark):
    files = spark.createDataFrame([(i, f"---\nid: {i}\nupdated: {u}\n---\nx") for i, u in (("a", 5), ("b", 9), ("c", 5), ("d", 1))], "file_id string, raw string")
    assert [r["note_id"] for r in nt.load(files, spark.createDataFrame([], VERSION), 10).collect()] == ["b", "a", "c", "d"]


def test_save_over_its_own_table(spark, tmp_path):
    table, log = str(tmp_path / "t"), str(tmp_path / "l")
    assert nt.saved(spark, table) is None
    nt.save(frame(spark, note("a", body="b")), table, log)
    for k in range(3):
        edits = spark.createDataFrame([("a", f"edit {k}")], "note_id string, body string")
        nt.save(history.apply_edits(nt.saved(spark, table), edits, 100 + k), table, log)
    (tmp_path / "t/snapshot=000000000009").mkdir()  # a save that never was committed
    assert [(r["body"], r["rev"]) for r in nt.saved(spark, table).collect()] == [("edit 2", 4)]
    assert {r["rev"] for r in spark.read.parquet(log).collect()} == {1, 2, 3, 4}
    assert len([p for p in (tmp_path / "t").iterdir() if (p / "_SUCCESS").exists()]) == 2


def test_foreign_version_lines_are_dropped(spark):
    lines = ['{"rev":1,"at":5,"title":"t","body":"one"}', '{"rev":2,"body":7}', '{"rev":3,"body":{"a":1}}', '{"rev":"4","body":"x"}', '{"rev":5,"at":"soon","title":6,"body":"five"}', '{"rev":6,"body":"six","mo', '[{"rev":7,"body":"x"}]']
    rows = nt.decode_versions(spark.createDataFrame([("n", x, i) for i, x in enumerate(lines)], "note_id string, line string, ord int")).collect()
    assert [(r["rev"], r["at"], r["title"], r["body"]) for r in rows] == [(1, 5, "t", "one"), (5, None, "", "five")]


def test_logs_are_cut_when_due(spark):
    log = spark.createDataFrame([(n, r, r, "t", "b") for n in ("a", "b") for r in range(1, 60)], "note_id string, rev int, at long, title string, body string")
    notes = frame(spark, note("a", rev=75), note("b", rev=76))
    kept = {n: {r["rev"] for r in history.compact_due(log, notes).where(f"note_id = '{n}'").collect()} for n in ("a", "b")}
    assert kept == {"a": set(range(10, 60)), "b": set(range(1, 60))}


def test_versions(spark):
    log = spark.createDataFrame([("n", r, r * 10, "t", "w " * (r % 5), o) for o, r in enumerate([1, 2, 2, 3, *range(4, 61)])], "note_id string, rev int, at long, title string, body string, ord int")
    v = history.dedupe_versions(log)
    assert v.count() == 60 and {r["rev"] for r in history.compact(v).collect()} == set(range(11, 61))
    d = {r["rev"]: r for r in history.version_deltas(v, frame(spark, note("n", body="w " * 0))).collect()}
    assert d[1]["delta"] is None and d[2]["delta"] == 1 and d[5]["delta"] == -4 and d[60]["is_current"] and not d[59]["is_current"]


def test_retention_is_strict(spark):
    df = frame(spark, note("a", trashed_at=0), note("b", trashed_at=1), note("c"))
    assert {r["note_id"] for r in history.purge(df, 30 * DAY + 1).collect()} == {"b", "c"}


def test_edits(spark):
    df = frame(spark, note("a", title="T", body="x"), note("b", body="y"))
    e = spark.createDataFrame([("a", None, "x", True), ("b", "new", None, None)], "note_id string, title string, body string, pinned boolean")
    r = {x["note_id"]: x for x in history.apply_edits(df, e, 5000).collect()}
    assert (r["a"]["rev"], r["a"]["updated_at"], r["a"]["pinned"]) == (1, 1000, True) and (r["b"]["rev"], r["b"]["updated_at"], r["b"]["title"]) == (2, 5000, "new")


def test_exports(spark):
    df = frame(spark, note("a", title="Trip", body="# TRIP\nx", updated_at=5), note("b", title="a/b: c", body="y", updated_at=9), note("c", title=" ", body="z", updated_at=1), note("d", title="gone", trashed_at=1))
    assert history.export_all(df).first()[0] == "# a/b: c\n\ny\n\n---\n\n# TRIP\nx\n\n---\n\nz"
    named = frame(spark, *[note(f"{i}", title=t, updated_at=100 - i) for i, t in enumerate(["X", "x", "X 2", "X", "", "a?b", "y" * 90])])
    names = {r["note_id"]: r["filename"] for r in history.export_filenames(named).collect()}
    assert names == {"0": "X.md", "1": "x 3.md", "2": "X 2.md", "3": "X 4.md", "4": "Untitled.md", "5": "a b.md", "6": "y" * 60 + ".md"}
    assert len({n.lower() for n in names.values()}) == 7


def test_export_digest(spark, monkeypatch):
    import hashlib

    from quillstack import catalog

    rows = frame(spark, *[note(f"{i}", title=f"t{i}", body="ü" * i, updated_at=i % 7, trashed_at=1 if i % 5 == 0 else None) for i in range(40)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        monkeypatch.setattr(catalog, "notes", lambda spark, d: rows)
        found = catalog.export_all(spark, "")
        assert "collect_list" not in found._jdf.queryExecution().toString()  # never there as a whole
        assert [r["digest"] for r in found.collect()] == [hashlib.md5(history.export_all(rows).first()[0].encode()).hexdigest()]
        assert history.export_digest(rows.where("note_id = '0'")).collect() == [(None,)]  # as string_agg of nothing
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ids():
    assert new_id(1_700_000_000_000, lambda: 0.5).endswith("-" + "i" * 8) and len(new_id(1)) == 18 and new_id(35, lambda: 0).startswith("00000000z-")


def test_snapshot_and_index_streams(spark, tmp_path):
    schema = "note_id string, rev int, at long, title string, body string"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for batch in ([("c", 1, 1, "t", "c")], [("a", 2, 20, "t", "second"), ("b", 1, 5, "t", "b")], [("a", 1, 10, "t", "first"), ("b", 2, 6, "t", "b2")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        st.maintain_snapshot(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert {r["note_id"]: r["body"] for r in st.newest(spark, f"{out}/snapshot").collect()} == {"a": "second", "b": "b2", "c": "c"}
    assert len(list((tmp_path / "out" / "snapshot").glob("batch=*"))) == 2 and len(list((tmp_path / "out" / "log").glob("batch=*"))) == 3
    src, out = str(tmp_path / "notes"), str(tmp_path / "index")
    for rows in ([note("a", body="old words"), note("b", body="stay")], [note("a", body="new words", updated_at=2000, rev=2)]):
        frame(spark, *rows).coalesce(1).write.mode("append").parquet(src)
        st.maintain_index(spark.readStream.schema(NOTE).parquet(src), out, str(tmp_path / "cp2")).awaitTermination()
    final = postings(frame(spark, note("a", body="new words"), note("b", body="stay")))
    kept = SegmentedIndex(spark, out).read()
    assert sorted(map(tuple, kept.postings.join(kept.docs.select(kept.key), kept.key).select(final.columns).collect())) == sorted(map(tuple, final.collect()))


def test_bursts(spark, tmp_path):
    rows = [("a", 0.0, 1, "a1"), ("a", 0.5, 2, "a2"), ("b", 0.9, 3, "b1"), ("a", 1.4, 4, "a3"), ("a", 9.0, 5, "a4")]
    df = spark.createDataFrame(rows, "note_id string, s double, event_id long, body string").select("note_id", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("ts"), "event_id", "body")
    own = {(r["note_id"], r["edits"], r["body"]) for r in st.coalesce_edits(df).collect()}
    assert own == {("a", 2, "a2"), ("b", 1, "b1"), ("a", 1, "a3"), ("a", 1, "a4")}
    shared = {(r["note_id"], r["edits"], r["body"]) for r in st.coalesce_edits(df, per_note=False).collect()}
    assert shared == {("a", 3, "a3"), ("b", 1, "b1"), ("a", 1, "a4")}
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    for per_note, expected in ((True, own), (False, shared)):
        q = st.coalesce_edits(stream, lateness="0 seconds", per_note=per_note).writeStream.format("memory").queryName(f"b{per_note}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r["note_id"], r["edits"], r["body"]) for r in spark.table(f"b{per_note}").collect()}
        assert got and got <= expected  # the last burst stays open until the watermark passes it


def test_bursts_of_the_library_across_ranges(spark):
    r = random.Random(4)
    for trial, range_edits in ((0, 1), (1, 3), (2, 7), (3, 10_000)):
        t, rows = -5000 * trial, []
        for i in range(120):
            t += r.choice([0, 1, 5, 9, 10, 11, 500 if trial % 2 else 30])
            rows.append((r.choice("abc"), t, i, f"b{i}"))
        df = spark.createDataFrame([*rows, ("a", None, 999, "never")], "note_id string, ms long, event_id long, body string").select("note_id", F.timestamp_millis("ms").alias("ts"), "event_id", "body")
        want, start, last = {}, None, None
        for n, t, i, b in sorted(rows, key=lambda x: (x[1], x[2])):
            start, last = (t if last is None or t - last >= 10 else start), t
            e = want.setdefault((start, n), [0, None])
            e[0], e[1] = e[0] + 1, b
            want[start, "end"] = t + 10
        found = {(x["from"], x["note_id"]): (x["to"], x["edits"], x["body"]) for x in st.library_bursts(df, "10 milliseconds", range_edits).select(F.unix_millis("from").alias("from"), F.unix_millis("to").alias("to"), "note_id", "edits", "body").collect()}
        assert found == {k: (want[k[0], "end"], *v) for k, v in want.items() if k[1] != "end"}
    assert st.coalesce_edits(df.where("ts is null"), per_note=False).collect() == []


def test_places_survive_what_is_cached_and_follow_a_locale(spark):
    titles = ["zebra", "Äpfel", "apfel", "Zebra", "ähre", "Apfel", "ohne", "Öl"]
    notes = frame(spark, *[note(f"n{i}", title=t, pinned=i == 6) for i, t in enumerate(titles)])
    by = lambda **how: [titles[int(r["note_id"][1:])] for r in sorted(placed(notes.repartition(5), "title", True, **how).collect(), key=lambda r: r["place"])]
    assert by() == ["ohne", "Apfel", "Zebra", "apfel", "zebra", "Äpfel", "Öl", "ähre"]
    assert by(collation="de") == ["ohne", "ähre", "apfel", "Apfel", "Äpfel", "Öl", "zebra", "Zebra"]
    rows = placed(notes, "title", True)
    spark.catalog.clearCache()
    assert sorted(r["place"] for r in rows.collect()) == list(range(1, 9)) and not spark.sparkContext._jsc.getPersistentRDDs()
