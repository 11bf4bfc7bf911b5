"""Version history and note lifecycle: deduplication, deltas, compaction, recovery, edits, trash, export."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.operators.links import extract_link_keys, extract_tags
from quillstack.schema import COMPACT_EVERY, HISTORY_KEPT, RETENTION_MS

EXPORT_RULE = "\n\n---\n\n"


def dedupe_versions(log: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each (note_id, rev): the last appended."""
    cols = [c for c in log.columns if c not in ("note_id", "rev", order)]
    last = log.groupBy("note_id", "rev").agg(F.max_by(F.struct(*cols), F.col(order)).alias("v"))
    return last.select("note_id", "rev", "v.*")


def version_deltas(versions: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """note_id, rev, at, words, delta (words against the version before; null for the first) and is_current."""
    by_note = Window.partitionBy("note_id").orderBy("rev", "at")
    rows = versions.withColumn("words", tx.word_count(F.col("body")))
    newest = F.lead("rev").over(by_note).isNull()
    rows = rows.withColumn("delta", F.col("words") - F.lag("words").over(by_note)).withColumn("_newest", newest)
    if current is None:
        return rows.select("note_id", "rev", "at", "words", "delta", F.col("_newest").alias("is_current"))
    rows = rows.join(current.select("note_id", F.col("body").alias("_now")), "note_id", "left")
    return rows.select("note_id", "rev", "at", "words", "delta", (F.col("_newest") & F.coalesce(F.col("body") == F.col("_now"), F.lit(False))).alias("is_current"))


def compact(versions: DataFrame, kept: int = HISTORY_KEPT) -> DataFrame:
    """The newest ``kept`` versions of each note."""
    place = F.row_number().over(Window.partitionBy("note_id").orderBy(F.desc("rev"), F.desc("at")))
    return versions.withColumn("_i", place).where(F.col("_i") <= kept).drop("_i")


def compact_due(versions: DataFrame, notes: DataFrame, every: int = COMPACT_EVERY, kept: int = HISTORY_KEPT) -> DataFrame:
    """``versions`` with the logs of the notes cut to the newest ``kept`` whose revision is a multiple of ``every``; those of the others as they are."""
    due = notes.where(F.col("rev") % every == 0).select("note_id").distinct()
    return compact(versions.join(due, "note_id", "left_semi"), kept).unionByName(versions.join(due, "note_id", "left_anti"))


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each note."""
    cols = [c for c in versions.columns if c != "note_id"]
    return versions.groupBy("note_id").agg(F.max_by(F.struct(*cols), F.struct("rev", "at")).alias("v")).select("note_id", "v.*")


def with_derived(notes: DataFrame) -> DataFrame:
    """Tags and link keys derived from the body anew."""
    return notes.withColumn("tags", extract_tags(F.col("body"))).withColumn("links", extract_link_keys(F.col("body")))


def recover(versions: DataFrame) -> DataFrame:
    """Notes rebuilt from their newest version; flags at their defaults."""
    v = latest(versions)
    no = F.lit(False)
    rows = v.select(
        "note_id", "title", "body", F.col("at").alias("created_at"), F.col("at").alias("updated_at"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("links"),
        no.alias("pinned"), no.alias("archived"), no.alias("locked"), F.lit(None).cast("bigint").alias("trashed_at"), F.col("rev").cast("int").alias("rev"),
    )
    return with_derived(rows)


def expired(now: int) -> Column:
    return F.col("trashed_at").isNotNull() & (F.lit(now) - F.col("trashed_at") > RETENTION_MS)


def purge(notes: DataFrame, now: int) -> DataFrame:
    """Notes without those in the trash for more than the retention."""
    return notes.where(~expired(now))


def trash(notes: DataFrame, ids: DataFrame, now: int, restore: bool = False, touch: bool = False) -> DataFrame:
    """``notes`` with those named by ``ids`` (note_id) put into the trash or taken out; ``touch`` dates the change."""
    hit = ids.select("note_id").distinct().withColumn("_hit", F.lit(True))
    rows = notes.join(hit, "note_id", "left")
    at = F.lit(None).cast("bigint") if restore else F.lit(now).cast("bigint")
    rows = rows.withColumn("trashed_at", F.when(F.col("_hit"), at).otherwise(F.col("trashed_at")))
    rows = rows.withColumn("rev", F.when(F.col("_hit"), F.col("rev") + 1).otherwise(F.col("rev")))
    if touch:
        rows = rows.withColumn("updated_at", F.when(F.col("_hit"), F.lit(now).cast("bigint")).otherwise(F.col("updated_at")))
    return rows.select(notes.columns)


def destroy(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Notes, or versions, without those of the named notes."""
    return rows.join(ids.select("note_id").distinct(), "note_id", "left_anti")


def empty_trash(notes: DataFrame) -> DataFrame:
    return notes.where("trashed_at is null")


def apply_edits(notes: DataFrame, edits: DataFrame, now: int) -> DataFrame:
    """``notes`` after edits (note_id and any of title, body, pinned, archived, locked; null leaves a field as it is).

    A change of title or body raises rev and dates the note; tags and links follow the body.
    """
    fields = [c for c in ("title", "body", "pinned", "archived", "locked") if c in edits.columns]
    e = edits.select("note_id", *[F.col(c).alias(f"_{c}") for c in fields])
    rows = notes.join(e, "note_id", "left")
    changed = {c: F.coalesce(F.col(f"_{c}") != F.col(c), F.lit(False)) for c in fields if c in ("title", "body")}
    rows = rows.withColumn("_body_changed", changed.get("body", F.lit(False)))
    rows = rows.withColumn("_changed", F.col("_body_changed") | changed.get("title", F.lit(False)))
    for c in fields:
        rows = rows.withColumn(c, F.coalesce(f"_{c}", c))
    rows = rows.withColumn("rev", F.when(F.col("_changed"), F.col("rev") + 1).otherwise(F.col("rev")))
    rows = rows.withColumn("updated_at", F.when(F.col("_changed"), F.lit(now).cast("bigint")).otherwise(F.col("updated_at")))
    rows = rows.withColumn("tags", F.when(F.col("_body_changed"), extract_tags(F.col("body"))).otherwise(F.col("tags")))
    rows = rows.withColumn("links", F.when(F.col("_body_changed"), extract_link_keys(F.col("body"))).otherwise(F.col("links")))
    return rows.select(notes.columns)


def export_text(title: Column, body: Column) -> Column:
    """The body, under its title as a heading unless it opens with it."""
    name = tx.trim(title)
    first = tx.trim(F.regexp_replace(F.substring_index(body, "\n", 1), r"^#{1,6}\s+", ""))
    return F.when((name == "") | (F.lower(first) == F.lower(name)), body).otherwise(F.concat(F.lit("# "), name, F.lit("\n\n"), body))


def export_base(title: Column) -> Column:
    base = tx.trim(F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|]', " "), rf"{tx.SPACE}+", " "))
    base = F.substring(base, 1, 60)
    return F.when(base == "", F.lit("Untitled")).otherwise(base)


def export_filenames(notes: DataFrame) -> DataFrame:
    """note_id, filename: safe and, case aside, different names; in load order the first keeps the plain one.

    A numbered name that another note's own title claims is passed over: numbers go to the free ones.
    """
    rows = notes.select("note_id", export_base(F.col("title")).alias("base"), "updated_at").withColumn("k", F.lower("base"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("updated_at"), "note_id")))
    # Titles that end like a numbered name take that number away from their stem.
    claims = rows.where("i = 1").select(F.regexp_extract("k", r"^(.*) ([1-9][0-9]{0,8})\z", 1).alias("k"), F.regexp_extract("k", r"^(.*) ([1-9][0-9]{0,8})\z", 2).alias("n")).where("k <> ''")
    taken = claims.groupBy("k").agg(F.sort_array(F.collect_set(F.col("n").cast("int"))).alias("taken"))
    rows = rows.join(taken, "k", "left")
    free = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("i"), lambda n, t: F.when((t >= 2) & (t <= n), n + 1).otherwise(n))
    name = F.when(F.col("i") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" "), free.cast("string")))
    return rows.select("note_id", F.concat(name, F.lit(".md")).alias("filename"))


def _export_rows(notes: DataFrame) -> DataFrame:
    """o (what the rows of an export are ordered by) and md, the text of each note outside the trash."""
    return notes.where("trashed_at is null").select(F.struct((-F.col("updated_at")).alias("u"), "note_id").alias("o"), export_text(F.col("title"), F.col("body")).alias("md"))


def export_all(notes: DataFrame) -> DataFrame:
    """One row with the text of all notes outside the trash, latest first. A value of a row has 2 GB at most and is held whole; ``export_digest`` has no such bound."""
    every = F.sort_array(F.collect_list(F.struct("o", "md")))
    return _export_rows(notes).agg(F.array_join(F.transform(every, lambda x: x["md"]), EXPORT_RULE).alias("document"))


def _md5_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, rule = None, EXPORT_RULE.encode()
    for batch in batches:
        for text in batch.column(0):
            if state is None:
                state = hashlib.md5(usedforsecurity=False)
            else:
                state.update(rule)
            state.update(text.as_buffer())
    if state is not None:
        yield pa.RecordBatch.from_pydict({"digest": [state.hexdigest()]})


def export_digest(notes: DataFrame) -> DataFrame:
    """One row with the MD5 of ``export_all``'s document, null where no note has a text, as of a string_agg.

    A digest follows the order of its bytes, so one task sees all texts; it sorts them with what memory it has
    and takes them by the batch, so the document is never there as a whole.
    """
    rows = _export_rows(notes).where("md is not null").repartition(1).sortWithinPartitions("o", "md").select(F.col("md").cast("binary").alias("md"))
    return rows.mapInArrow(_md5_of_texts, "digest string").agg(F.max("digest").alias("digest"))
