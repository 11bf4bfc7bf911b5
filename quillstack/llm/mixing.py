"""Mixing sources to target weights along a low-discrepancy schedule.

Targets: sources share a multiple of all words by weight, none above a multiple of its own words; what a
capped source cannot take is shared among the others. Blocks: a source's documents, in a seeded random
order, form one stream of words that is cut into blocks of equal length. Schedule: multiples of the golden
ratio modulo 1 fall through the cumulative weights and name a source for each slot; the r-th slot of a
source takes its r-th block, starting over after the last. The last slot of a source ends at its target.

Word offsets and slot ranks come from sums of ranges plus an order inside each range, so a source with a
third of all words is dealt to many tasks. Texts are read once, for their word counts. The mix is the slots
in order, each with its block's pieces of documents; what a document gives is the sum of its pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import empty_text, materialize, named, running_total

GOLDEN = 0.6180339887498949
#: Weights of the sources in code-point order, repeating; share of all words; most that a source gives.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK_WORDS, RANGE_ROWS, SEED = 4096, 64, 29
#: Cells of [0, 1) through which points find their source, and slots ranked together.
CELLS, SLOT_RANGE = 1024, 4096

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """docs: doc_id, source, size, draw (its random number), offset (its place in the source's stream) and the plan's key columns; sources: source, source_size,
    target, quota, blocks, slots; schedule: slot, source, rank, block, words (taken from the block's start)."""

    docs: DataFrame
    sources: DataFrame
    schedule: DataFrame
    block_words: int


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size). The one window without a key has a row per source."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(every) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    rows = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(most))
    full = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    below, onward = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))
    rows = rows.withColumn("_left", left).withColumn("_over", F.sum("_w").over(onward)).withColumn("_k", F.row_number().over(full))
    rows = rows.withColumn("_level", F.col("_left") / F.col("_over"))
    open_ = F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.struct("_k", "_left", "_over"))
    rows = rows.withColumn("_at", F.min(open_).over(whole))  # the first source that the level doesn't fill
    target = F.when(F.col("_k") < F.col("_at._k"), F.col("_cap")).otherwise(F.coalesce(F.least("_cap", F.col("_w") * F.col("_at._left") / F.col("_at._over")), F.col("_cap")))
    return rows.select("source", "source_size", target.alias("target"))


def golden_point(k: Column) -> Column:
    """k times the golden ratio modulo 1, in two parts so that large k keep their precision."""
    high = F.floor(k / (1 << 20)) * ((GOLDEN * (1 << 20)) % 1.0)
    sum_ = high + (k % (1 << 20)) * GOLDEN
    return sum_ - F.floor(sum_)


def random_number(seed: int) -> Column:
    """48 random bits that follow from the doc_id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED, keys: tuple[str, ...] = ()) -> Mix:
    """The mix of ``docs`` (doc_id, text, source). Null texts have no words; a null source comes last; null ids
    share one random number; rows equal in doc_id and size are interchangeable; texts of any length are
    counted whole; an empty table gives empty tables; other columns are ignored, but for ``keys``, which
    go along with the rows and tell equal ones apart."""
    spark = docs.sparkSession
    ranges = max(1, docs.count() // RANGE_ROWS)
    rows = docs.select(*keys, "doc_id", "source", random_number(seed).alias("_draw"), F.regexp_count(empty_text(), F.lit(WORDS)).cast("long").alias("size"))
    rows = materialize(rows.withColumn("_range", F.expr(f"(_draw * {ranges}D / {1 << 48}D)").cast("long")), "mix-sizes")

    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("_n"))
    sizes = sums.groupBy("source").agg(F.sum("_n").alias("source_size"))
    sources = source_targets(sizes, weights, share, most)
    sources = sources.withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.floor(F.col("source_size") * float(most))).cast("long"))
    sources = sources.withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    full = F.expr("case when source_size > 0 then (quota div source_size) * blocks else 0 end")
    part = F.expr(f"case when source_size > 0 then (quota % source_size + {block_words - 1}) div {block_words} else 0 end")
    sources = materialize(sources.withColumn("slots", full + part), "mix-sources")

    starts = running_total(sums, ["source"], "_range", "_n", "_start").select(F.col("source").alias("_source"), F.col("_range").alias("_at"), "_start")
    inside = Window.partitionBy("source", "_range").orderBy("_draw", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_at")))
    placed = placed.select(*keys, "doc_id", "source", "size", F.col("_draw").alias("draw"), (F.col("_start") + F.col("_in")).alias("offset"))

    return Mix(materialize(placed, "mix-docs"), sources, materialize(_schedule(spark, sources, block_words), "mix-schedule"), block_words)


def _schedule(spark, sources: DataFrame, block_words: int) -> DataFrame:
    n_slots = sources.agg(F.sum("slots")).first()[0] or 0
    order = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, 0))
    arcs = sources.where("slots > 0").select("source", "source_size", "quota", "blocks", "slots", ((upto - F.col("slots")) / n_slots).alias("_lo") if n_slots else F.lit(0.0).alias("_lo"), (upto / n_slots).alias("_hi") if n_slots else F.lit(0.0).alias("_hi"))
    cut = arcs.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS), F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1)))))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("_x")).withColumn("_cell", F.floor(F.col("_x") * CELLS))
    hit = points.join(cut, "_cell").where("_x >= _lo and _x < _hi").select("slot", "source").withColumn("_range", F.expr(f"slot div {SLOT_RANGE}"))
    counted = hit.groupBy("source", "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = running_total(counted, ["source"], "_range", "_n", "_start").select(F.col("source").alias("_source"), F.col("_range").alias("_at"), "_start")
    place = F.row_number().over(Window.partitionBy("source", "_range").orderBy("slot")) - 1
    ranked = hit.withColumn("_in", place).join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_at")))
    ranked = ranked.select("slot", "source", (F.col("_start") + F.col("_in")).alias("rank"))
    # A source's points may miss its slots by a few: extra ranks go, missing ones follow after the schedule.
    got = counted.groupBy("source").agg(F.sum("_n").alias("_got")).withColumnRenamed("source", "_source")
    short = arcs.join(got, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_got", F.coalesce("_got", F.lit(0))).where("_got < slots")
    late = short.select(F.explode(F.sequence(F.col("_got"), F.col("slots") - 1)).alias("rank"), "source").select((F.lit(n_slots) + F.col("rank")).alias("slot"), "source", "rank")
    keys = arcs.select(F.col("source").alias("_source"), "source_size", "quota", "blocks", "slots")
    every = ranked.unionByName(late).join(keys, F.col("source").eqNullSafe(F.col("_source"))).where("rank < slots")
    every = every.withColumn("block", F.expr("rank % blocks"))
    before = F.expr(f"(rank div blocks) * source_size + block * {block_words}")
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    return every.select("slot", "source", "rank", "block", F.least(length, F.col("quota") - before).alias("words"))


def mix_pieces(mix: Mix) -> DataFrame:
    """slot, source, rank, block, doc_id, size, draw, offset and words for each document that a slot's block holds words of.

    Sorted by slot, source and offset these rows are the mix: a block is a piece of its source's stream, and a
    slot that takes only a part of it takes the block's first words.
    """
    size = mix.block_words
    parts = mix.docs.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(offset div {size}, (offset + size - 1) div {size})")))
    parts = parts.withColumn("_lo", F.greatest(F.col("offset") - F.col("block") * size, F.lit(0)))
    parts = parts.withColumn("_hi", F.least(F.col("offset") + F.col("size") - F.col("block") * size, F.lit(size)))
    slots = mix.schedule.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "slot", "rank", F.col("words").alias("_words"))
    met = parts.join(slots, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")) & (F.col("_words") > F.col("_lo")))
    return met.select("slot", "source", "rank", "block", "doc_id", "size", "draw", "offset", (F.least("_words", "_hi") - F.col("_lo")).alias("words"))


def _taken(mix: Mix) -> DataFrame:
    """The rows of mix.docs with the words taken of each and the first slot that takes any, added up over the pieces of the mix."""
    # Rows with words differ in their offsets; the others have no piece.
    used = mix_pieces(mix).groupBy(F.col("source").alias("_source"), F.col("offset").alias("_offset")).agg(F.sum("words").alias("_sum"), F.min("slot").alias("first_slot"))
    some = mix.docs.where("size > 0").join(used, F.col("source").eqNullSafe(F.col("_source")) & (F.col("offset") == F.col("_offset")), "left")
    none = mix.docs.where("size = 0").select("*", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return some.select(*mix.docs.columns, F.coalesce("_sum", F.lit(0)).alias("taken"), "first_slot").unionByName(none)


def mixed_words(mix: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_slot for every document of the mix.

    taken adds up what the slots' blocks hold of the document; first_slot is null where no slot takes any.
    A document without words has taken 0; rows that repeat are rows of their own; an empty table gives none.
    """
    keys = mix.sources.select(F.col("source").alias("_source"), "source_size", "target")
    rows = _taken(mix).join(keys, F.col("source").eqNullSafe(F.col("_source")))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixed_rows(docs: DataFrame, seed: int = SEED, **plan) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in the order of the schedule and in the same columns.

    A copy stands where the slot is whose block holds its first word in that round. The document that a
    source's target cuts is taken whole or not at all, whichever is nearer. Null, empty and blank texts have
    nothing to give and go; rows that share source and doc_id (nulls among them) are rows of their own; very
    long texts are rows like any other; an empty table gives none; columns may have any names. The rows are
    written once with a number of their own, by which they meet their places. Texts travel twice: to their
    places, and from there to the order.
    """
    spark = docs.sparkSession
    row = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row")
    held = materialize(docs.where(F.col("text").rlike(WORDS)).select(row, F.monotonically_increasing_id().alias("_key")), "mix-rows")
    at = {c: F.col(f"_row.c{docs.columns.index(c)}").alias(c) for c in ("doc_id", "source", "text")}
    mix = plan_mix(held.select("_key", *at.values()), seed=seed, keys=("_key",), **plan)
    first = _taken(mix).where("taken > 0").select("_key", "source", "offset", "size", "taken")
    first = first.withColumn("block", F.expr(f"offset div {mix.block_words}")).withColumn("times", F.floor(F.col("taken") / F.col("size") + 0.5))
    turns = mix.schedule.join(mix.sources.select(F.col("source").alias("_s"), "blocks"), F.col("source").eqNullSafe(F.col("_s")))
    turns = turns.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "slot", F.expr("rank div blocks").alias("round"))
    copies = first.join(turns, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")) & (F.col("round") < F.col("times")))
    places = copies.groupBy("_key").agg(F.collect_list(F.struct("slot", "source", "offset")).alias("_at"))  # a place a round
    places = materialize(places, "mix-places")
    last = mix.schedule.agg(F.coalesce(F.max("slot"), F.lit(0))).first()[0]
    rows = held.join(places, "_key").select(F.explode("_at").alias("_p"), "_row")
    # Slots hold equal numbers of words, so that equal runs of slots make even parts in order, without a sample of the rows.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionById(parts, F.expr(f"cast(_p.slot * {parts}L div {last + 1}L as int)")).sortWithinPartitions("_p.slot", "_p.source", "_p.offset")
    return rows.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
