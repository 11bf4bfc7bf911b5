"""Structured Streaming over edits: coalescing bursts, keeping the snapshot and the index up to date, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.operators.expand import settled
from quillstack.operators.history import latest, purge
from quillstack.operators.index import Index, build_index
from quillstack.operators.segments import SegmentedIndex

#: How late an edit may come.
LATENESS = "10 minutes"


def coalesce_edits(edits: DataFrame, gap: str = "600 milliseconds", lateness: str = LATENESS, per_note: bool = True) -> DataFrame:
    """note_id, from, to, edits and the last body of each burst of (note_id, ts, event_id, body).

    A burst ends when ``gap`` passes without an edit: of the note with ``per_note``; of any note without it. The
    first works on a stream and on a table alike; bursts of the whole library are found in a table by
    ranges of time (``library_bursts``), while in a stream they are one state.
    """
    if not per_note and not edits.isStreaming:
        return library_bursts(edits, gap)
    rows = edits.withWatermark("ts", lateness)
    burst = F.session_window("ts", gap)
    if per_note:
        out = rows.groupBy("note_id", burst).agg(F.count(F.lit(1)).alias("edits"), F.max(F.struct("ts", "event_id", "body")).alias("last"))
        return out.select("note_id", F.col("session_window.start").alias("from"), F.col("session_window.end").alias("to"), "edits", F.col("last.body").alias("body"))
    item = F.struct("note_id", F.struct("ts", "event_id", "body").alias("e"))
    every = rows.groupBy(F.col("note_id").isNotNull().alias("library"), burst).agg(F.collect_list(item).alias("items"))
    # A second aggregation of a stream would need its own state: the burst's rows are at hand.
    ids = F.array_distinct(F.transform("items", lambda x: x["note_id"]))
    of = lambda n: F.filter("items", lambda x: x["note_id"] == n)
    flat = every.select("session_window", F.explode(F.transform(ids, lambda n: F.struct(n.alias("note_id"), F.size(of(n)).alias("edits"), F.array_max(F.transform(of(n), lambda x: x["e"])).alias("last")))).alias("x"))
    return flat.select("x.note_id", F.col("session_window.start").alias("from"), F.col("session_window.end").alias("to"), F.col("x.edits").cast("long").alias("edits"), F.col("x.last.body").alias("body"))


#: Edits that a range of time has in the mean.
RANGE_EDITS = 65_536


def library_bursts(edits: DataFrame, gap: str, range_edits: int = RANGE_EDITS) -> DataFrame:
    """note_id, from, to, edits, body: the bursts of a table of edits, whichever notes they are of.

    Time is cut into ranges, none shorter than the gap, that have ``range_edits`` edits in the mean. Each range
    finds the bursts that begin in it. What comes before the first of them goes on from the range before
    if that ended less than a gap ago: such heads take their start from there, over several ranges by
    doubling. Edits without a time are no part of any burst.
    """
    spark = edits.sparkSession
    rows = edits.where("ts is not null").select("note_id", "ts", "event_id", "body", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    wait, n, span = rows.agg(F.max(F.expr(f"unix_micros(timestamp_micros(0) + interval {gap})")), F.count(F.lit(1)), F.max("t") - F.min("t")).first()
    if not n:
        return edits.limit(0).select("note_id", F.col("ts").alias("from"), F.col("ts").alias("to"), F.lit(0).cast("long").alias("edits"), "body")
    width = max(wait, -(-(span + 1) * range_edits // n))
    inside = Window.partitionBy("range").orderBy("t", "event_id")
    rows = rows.withColumn("range", F.expr(f"t div {width}") - F.when((F.col("t") < 0) & (F.col("t") % width != 0), 1).otherwise(0))
    before = F.lag("t").over(inside)
    rows = rows.withColumn("fresh", F.when(F.col("t") - before >= wait, F.col("t"))).withColumn("start", F.last("fresh", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = settled(rows.select("note_id", "ts", "event_id", "body", "t", "range", "start"), False, "bursts-rows")

    ends = rows.groupBy("range").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("start").alias("tail"))
    earlier = ends.select((F.col("range") + 1).alias("range"), F.col("last").alias("_last"), F.col("tail").alias("_tail"))
    goes_on = F.coalesce(F.col("first") - F.col("_last") < wait, F.lit(False))
    heads = ends.join(earlier, "range", "left").select("range", F.when(~goes_on, F.col("first")).otherwise(F.col("_tail")).alias("head"), (F.col("range") - 1).alias("up"))
    heads = settled(heads, False, "bursts-heads")
    while not heads.where("head is null").isEmpty():
        above = heads.select(F.col("range").alias("up"), F.col("head").alias("_head"), F.col("up").alias("_up"))
        heads = settled(heads.join(above, "up", "left").select("range", F.coalesce("head", "_head").alias("head"), F.coalesce("_up", "up").alias("up")), False, "bursts-heads")

    named = rows.join(heads.select("range", "head"), "range").withColumn("start", F.coalesce("start", "head"))
    last = F.max(F.struct("ts", "event_id", "body")).alias("last")
    notes = named.groupBy("start", "note_id").agg(F.count(F.lit(1)).alias("edits"), last)
    bursts = named.groupBy("start").agg(F.max("t").alias("end"))
    of_kind = lambda c: F.timestamp_micros(c).cast(edits.schema["ts"].dataType)
    return notes.join(bursts, "start").select("note_id", of_kind(F.col("start")).alias("from"), of_kind(F.col("end") + wait).alias("to"), "edits", F.col("last.body").alias("body"))


def latest_snapshot(versions: DataFrame) -> DataFrame:
    """The newest version of each note, whatever the order in which versions came."""
    return latest(versions)


def _swap(spark: SparkSession, rows: DataFrame, path: str, batch: int) -> str:
    """Writes a snapshot of its own for the batch, so that a repeated batch writes the same one again."""
    where = f"{path}/batch={batch:012d}"
    rows.write.mode("overwrite").parquet(where)
    return where


def _complete(spark: SparkSession, path: str) -> dict[int, str]:
    """The complete snapshots under ``path`` by their batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().toString() for s in fs.listStatus(hadoop.Path(path))] if fs.exists(hadoop.Path(path)) else []
    return {int(n.rpartition("=")[2]): n for n in names if "batch=" in n and fs.exists(hadoop.Path(n + "/_SUCCESS"))}


def newest(spark: SparkSession, path: str) -> DataFrame | None:
    """The last complete snapshot under ``path``."""
    return newest_before(spark, path, 1 << 62)


def newest_before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """The last complete snapshot of a batch before ``number``."""
    found = _complete(spark, path)
    last = max((n for n in found if n < number), default=None)
    return None if last is None else spark.read.parquet(found[last])


def _drop_old(spark: SparkSession, path: str, number: int) -> None:
    """Removes the snapshots that not even a repetition of batch ``number`` reads: all but its own and the one before."""
    found = _complete(spark, path)
    for n in sorted(n for n in found if n < number)[:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(found[n])
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def maintain_snapshot(stream: DataFrame, path: str, checkpoint: str):
    """A query that folds a stream of versions (note_id, rev, at, title, body) into a snapshot of the newest ones.

    The log of the batch is appended before the snapshot moves on; replays write the same files again. The
    snapshot before is kept for that, older ones are removed.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={number:012d}")
        before = newest_before(spark, f"{path}/snapshot", number)
        rows = batch if before is None else before.unionByName(batch)
        _swap(spark, latest(rows), f"{path}/snapshot", number)
        _drop_old(spark, f"{path}/snapshot", number)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_index(stream: DataFrame, path: str, checkpoint: str):
    """A query that keeps a searchable index (``SegmentedIndex``) for a stream of changed notes.

    stream: schema NOTE and, if notes can go, a column ``deleted``. Of a note's changes in a batch the one with
    the greatest updated_at and rev counts. A repeated batch does nothing.
    """

    def take_in(batch: DataFrame, number: int) -> None:
        rows = batch if "deleted" in batch.columns else batch.withColumn("deleted", F.lit(False))
        cols = [c for c in rows.columns if c != "note_id"]
        last = rows.groupBy("note_id").agg(F.max_by(F.struct(*cols), F.struct("updated_at", "rev")).alias("v")).select("note_id", "v.*")
        gone = F.coalesce("deleted", F.lit(False))
        SegmentedIndex(batch.sparkSession, path).apply(last.where(~gone).drop("deleted"), last.where(gone).select("note_id"), number)

    return stream.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retention(notes: DataFrame, now: int) -> DataFrame:
    """Notes without those whose time in the trash is over; for a table or a stream."""
    return purge(notes, now)


def rebuild(notes: DataFrame) -> Index:
    return build_index(notes)
