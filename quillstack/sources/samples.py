"""Notes, versions and edits derived from generic document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.operators.links import extract_link_keys, extract_tags

BASE_MS, HOUR_MS = 1_704_067_200_000, 3_600_000
NOW_MS = BASE_MS + 4000 * HOUR_MS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores dealt out to all of them; any larger one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as notes: each with a tag, most with a wikilink, every third an open or a done task, flags by doc_id."""
    d = table(spark, sf_dir, "documents")
    body = F.concat(
        F.coalesce("text", F.lit("")), F.lit("\n#"), "lang", F.lit("/"), "source",
        F.when(F.col("doc_id") % 23 != 22, F.concat(F.lit("\n[[doc "), (F.col("doc_id") * 7 % 1200).cast("string"), F.lit("]]"))).otherwise(""),
        F.when(F.col("doc_id") % 3 == 0, "\n- [ ] open").when(F.col("doc_id") % 3 == 1, "\n- [x] done").otherwise(""),
    )
    rows = d.select(
        F.col("doc_id").cast("string").alias("note_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), body.alias("body"),
        (F.lit(BASE_MS) + F.col("doc_id") * HOUR_MS).alias("created_at"), (F.lit(BASE_MS) + F.col("doc_id") * 7919 % 2000 * HOUR_MS).alias("updated_at"),
        (F.col("doc_id") % 17 == 0).alias("pinned"), (F.col("doc_id") % 11 == 0).alias("archived"), (F.col("doc_id") % 19 == 0).alias("locked"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(BASE_MS) + F.col("doc_id") * 7919 % 2000 * HOUR_MS).alias("trashed_at"), (1 + F.col("doc_id") % 60).cast("int").alias("rev"),
    )
    tagged = rows.withColumn("tags", extract_tags(F.col("body"))).withColumn("links", extract_link_keys(F.col("body")))
    return tagged.select("note_id", "title", "body", "created_at", "updated_at", "tags", "links", "pinned", "archived", "locked", "trashed_at", "rev")


def conversation_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a version log: turns are revisions, the role stands for the title."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("note_id"), (F.col("turn") + 1).cast("int").alias("rev"), (F.lit(BASE_MS) + F.col("turn") * 60_000).alias("at"), F.col("role").alias("title"), F.coalesce("text", F.lit("")).alias("body"), F.col("turn").alias("ord"))


def event_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of edits: a user is a note, an event replaces its body."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("note_id"), F.col("ts"), F.col("event_id"), F.col("event_type").alias("body"))
