"""Placed listings: the order of a sorted list as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.operators.expand import settled
from quillstack.operators.links import sort_notes


def placed(notes: DataFrame, key: str, ascending: bool, limit: int | None = None, collation: str | None = None) -> DataFrame:
    """place, note_id of the notes, or the first ``limit`` of them, in the listing's order.

    A place is the number of rows in the sort's earlier parts and the place in its own part, so no task sees
    all rows. The sorted ids are written first: sorting them again, after a loss, could cut the parts elsewhere.
    """
    rows = sort_notes(notes, key, ascending, collation)
    rows = (rows if limit is None else rows.limit(limit)).select("note_id")
    part = F.spark_partition_id().alias("part")
    kept = settled(rows.select("note_id", part, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), False, "listing")
    sizes = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each part of the sort
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.join(sizes.select("part", before.alias("before")), "part").select("note_id", (F.col("before") + F.col("i") + 1).alias("place"))
