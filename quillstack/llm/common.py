"""Shared pieces of the training-data operators: scratch tables, column guards, prefix sums, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.scratch import new_folder, remove_folder

ARROW_BYTES = 8 << 20

def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the written table.

    This cuts the lineage and makes later reads independent of any executor's local disk.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Lets Arrow batches have ARROW_BYTES at most for as long as this lasts: a batch is held several times over, in the
    JVM's buffers, on its way and in the worker, by each task of an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Remove a scratch table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove_folder(path)


def named(column: str) -> Column:
    """A column by its name as it is, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def empty_text(name: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def running_total(df: DataFrame, group: list[str], order: str, value: str, out: str, fan: int = 1024) -> DataFrame:
    """Exclusive running sum of ``value`` by the integer column ``order`` inside ``group``; one row per (group, order).

    Two levels, so that no task gathers all rows of a group: blocks of ``fan`` orders are summed, the block
    sums are accumulated (a ``fan``-th of the rows), and each block accumulates its own rows.
    """
    block = F.expr(f"{order} div {fan}")
    blocks = df.groupBy(*group, block.alias("_block")).agg(F.sum(value).alias("_sum"))
    above = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*group, "_block", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_block", block).withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    if not group:  # a constant group keeps both joins on plain columns
        return rows.join(blocks, "_block").select(order, (F.col("_before") + F.col("_inside")).alias(out))
    same = [rows[g].eqNullSafe(blocks[g]) for g in group] + [rows["_block"] == blocks["_block"]]
    return rows.join(blocks, same).select(*[rows[g] for g in group], rows[order], (F.col("_before") + F.col("_inside")).alias(out))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the least node reachable.

    Contraction in rounds: each node points to its least neighbour, pointers are doubled until they reach a
    root, edges are rewritten to roots and those that became loops go. Nothing but one flag per step
    reaches the driver; every step is a written table, so a lost executor costs one step.
    """
    a, b = F.col("a"), F.col("b")
    live = materialize(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "cc-edges")
    label = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).union(live.select("b", "a"))
        parent = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "cc-parent")
        moved = True
        while moved:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            step = materialize(parent.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "cc-jump")
            moved = not step.where("moved").isEmpty()
            discard(parent)
            parent = step.drop("moved")
        pa, pb = (parent.select(F.col("u").alias(k), F.col("p").alias(f"p{k}")) for k in "ab")
        rest = live.join(pa, "a").join(pb, "b").where("pa <> pb")
        rest = materialize(rest.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        found = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        if label is None:
            label = found
        else:
            label = materialize(label.join(found.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "cc-label")
        discard(live)
        live = rest
    if label is None:
        label = live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return label
