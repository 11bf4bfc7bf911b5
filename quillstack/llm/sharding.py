"""Sharding by proportional stratified interleaving.

Rows of a source are ranked in a seeded random order; the rank as a fraction of the source's size places
each row on [0, 1), and rows of all sources sorted by that fraction form one sequence in which every
stretch holds the sources in their corpus proportions. Cutting the sequence evenly gives shards that match
the mixture, with row counts at most one apart (law ``rows``).

Only sizes and hashes are shuffled, never texts. Ranks come from counts of hash ranges plus an order inside
each range, so a source with a third of all rows is dealt to as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import empty_text, running_total

#: Mean rows of a hash range; sets how finely ranks are cut, never which rows are seen.
RANGE_ROWS = 64


def interleaved_shards(docs: DataFrame, n_shards: int = 24, seed: int = 17, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text, source).

    The order inside a source is by md5(seed:doc_id), then doc_id, text_crc32 and size; rows equal in all
    of these are interchangeable. Each source starts at an offset drawn from its name, so that many small
    sources spread out too. Null texts have no bytes; a null source is a source of its own; a null doc_id
    is ranked as the text "null"; an empty table gives no rows; other columns are ignored.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")  # 48 bits
    total = docs.count()
    ranges = max(1, total // range_rows)
    keyed = docs.select("doc_id", "source", draw.alias("_draw")).withColumn("_range", F.expr(f"(_draw * {ranges}D / {1 << 48}D)").cast("long"))
    counted = keyed.groupBy("source", "_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = counted.groupBy("source").agg(F.sum("_n").alias("_of"))
    starts = running_total(counted, ["source"], "_range", "_n", "_start")
    sizes = sizes.withColumnRenamed("source", "_source")
    starts = starts.join(sizes, F.col("source").eqNullSafe(F.col("_source"))).drop("source").withColumnRenamed("_range", "_at")

    rows = docs.select(
        "doc_id", "source", draw.alias("_draw"),
        (F.octet_length(empty_text()) + 8).cast("long").alias("size"),
        F.crc32(empty_text().cast("binary")).alias("text_crc32"),
    ).withColumn("_range", F.expr(f"(_draw * {ranges}D / {1 << 48}D)").cast("long"))
    order = ["_draw", "doc_id", "text_crc32", "size"]
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("source", "_range").orderBy(*order)) - 1)
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_at"))).drop("_source", "_at")

    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    phase = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), name)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rows = rows.withColumn("_frac", (F.col("_start") + F.col("_in") + phase) / F.col("_of"))
    rows = rows.withColumn("_cell", F.least(F.floor(F.col("_frac") * ranges), F.lit(ranges - 1)).cast("long"))
    # Each source's rows in a cell follow from its size alone, so cells need no second look at the rows.
    cells = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = running_total(cells, [], "_cell", "_n", "_before")
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_frac", "source", *order)) - 1
    rows = rows.withColumn("_place", place).join(before, "_cell").withColumn("_pos", F.col("_before") + F.col("_place"))
    rows = rows.withColumn("shard", F.expr(f"_pos * {n_shards} div {max(1, total)}").cast("int"))
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return rows.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("_pos") - first).cast("long").alias("slot"))
