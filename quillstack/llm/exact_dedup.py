"""Exact deduplication through an extendible-hash index on shared files.

Directory: a first look at the table counts the rows of each 64-bit hash. The hash's leading bits address
buckets; a bucket with more hashes than its capacity is split by one further bit, which doubles the
directory when the bucket is as deep as it. Directory and buckets are tables, built by counting prefixes.
Owners: every row travels to the task that owns its bucket, which is a range of hashes. There the rows of
one hash form a chain with an entry for each different text: a row joins the entry whose bytes equal its
own, so that texts which share a hash stay apart. The entries, with the ids that met in them, are written
to the shared folder in order of bucket and hash; verdicts are read from there.

A hash that many rows share is dealt to several owners by a salt, and its entries, one for each text and
salt, are put together by their bytes afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import empty_text, materialize, named

#: Hashes of a bucket before it is split; a bucket holds 2 ** -18 of them all at least, so that the directory stays small enough to broadcast.
BUCKET_CAPACITY, BUCKETS_LOG2 = 256, 18
#: Rows of a hash that one owner takes; a millionth of all rows at least, so that at most a million hashes are salted.
OWNER_ROWS, SALTED_MOST = 256, 1_000_000
#: Cells of a directory that is broadcast; a larger one is joined by a shuffle.
CELLS_AT_HAND = 1 << 21


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")


def build_directory(hashes: DataFrame, capacity: int | None = None) -> tuple[DataFrame, int]:
    """The directory (cell, bucket) of the distinct ``hashes`` (hash) and its depth: a cell is a prefix of that many bits.

    A bucket is named by its first cell. It is split while it holds more than ``capacity`` hashes; only hashes
    that still lie together where the directory has 64 cells for each of them are left in one bucket.
    """
    spark, n = hashes.sparkSession, hashes.count()
    capacity = capacity or max(BUCKET_CAPACITY, n >> BUCKETS_LOG2)
    leaves, depth, deepest = None, 0, min(62, n.bit_length() + 6)
    live, more = hashes.select("hash"), (n // capacity).bit_length() + 1
    overfull = n > capacity
    while overfull and depth < deepest:
        below = min(deepest, depth + more)
        cells = live.groupBy(_prefix(below).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        levels = cells.select("n", "cell", F.explode(F.sequence(F.lit(depth + 1), F.lit(below))).alias("depth"))
        prefix = F.expr(f"shiftrightunsigned(cell, {below} - depth)").alias("prefix")
        nodes = materialize(levels.groupBy("depth", prefix).agg(F.sum("n").alias("n")), "dedup-nodes")
        split = nodes.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        under = nodes.withColumn("up", F.shiftright("prefix", 1))
        reached = under.where(F.col("depth") == depth + 1).unionByName(under.where(F.col("depth") > depth + 1).join(split, ["depth", "up"], "left_semi"))
        done = reached.where((F.col("n") <= capacity) | (F.col("depth") == deepest)).select("depth", "prefix")
        leaves = done if leaves is None else leaves.union(done)
        left = nodes.where((F.col("depth") == below) & (F.col("n") > capacity)).select(F.col("prefix").alias("cell"))
        overfull = below < deepest and not left.isEmpty()
        if overfull:
            live = live.withColumn("cell", _prefix(below)).join(left, "cell", "left_semi").select("hash")
        depth, more = below, 4
    if leaves is None:
        return spark.range(1).select(F.col("id").alias("cell"), F.col("id").alias("bucket")), 0
    leaves = materialize(leaves, "dedup-buckets")
    depth = leaves.agg(F.max("depth")).first()[0]
    first, width = F.expr(f"shiftleft(prefix, {depth} - depth)"), F.expr(f"shiftleft(1L, {depth} - depth)")
    return materialize(leaves.select(F.explode(F.sequence(first, first + width - 1)).alias("cell"), first.alias("bucket")), "dedup-directory"), depth


def _routed(docs: DataFrame, key, capacity: int | None, owner_rows: int | None, *columns: Column) -> tuple[DataFrame, DataFrame, bool]:
    """Rows (bucket, hash, _text, ``columns``) of the hashes with one owner; rows of the others with a salt beside it; whether there are any of these."""
    text = empty_text()
    hashes = materialize(docs.select(key(text).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "dedup-hashes")
    directory, depth = build_directory(hashes, capacity)
    if 1 << depth <= CELLS_AT_HAND:
        directory = F.broadcast(directory)  # as many cells at most
    total = hashes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = owner_rows or max(OWNER_ROWS, total // SALTED_MOST)
    hot = materialize(hashes.where(F.col("n") > most).select("hash", F.ceil(F.col("n") / most).alias("_parts")), "dedup-salted")
    any_hot = not hot.isEmpty()
    rows = docs.select(text.alias("_text"), *columns).withColumn("hash", key(F.col("_text")))
    rows = rows.withColumn("cell", _prefix(depth)).join(directory, "cell").drop("cell")
    if not any_hot:
        return rows, rows, False
    hot = F.broadcast(hot)  # at most total / most rows, SALTED_MOST with the default
    return rows.join(hot, "hash", "left_anti"), rows.join(hot, "hash"), True


def build_index(docs: DataFrame, capacity: int | None = None, owner_rows: int | None = None, key: Callable[[Column], Column] = text_hash) -> DataFrame:
    """bucket, hash, text_sha256, keep_id, group_size and ids (of doc_id): the entries on shared files.

    An entry is a distinct text; one of a salted hash is cut into as many rows as owners have met it, each
    with its own ids and with keep_id and group_size of the whole. Rows of a bucket and hash stand together:
    the chain of the texts that share the hash.
    """
    one, many, any_hot = _routed(docs, key, capacity, owner_rows, F.col("doc_id"))

    def entries(rows: DataFrame, *by: str) -> DataFrame:
        # Dealt by bucket first, so that grouping needs no further shuffle: the owner compares the bytes in a chain.
        met = rows.repartition(*by).groupBy(*by, "hash", "_text")
        return met.agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.collect_list(F.struct("doc_id")).alias("ids"))

    names = ["bucket", "hash", "text_sha256", "keep_id", "group_size", "ids"]
    out = entries(one, "bucket").withColumn("text_sha256", F.sha2("_text", 256)).select(*names)
    if any_hot:
        salted = many.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("_parts")))
        whole = Window.partitionBy("hash", "_text")  # a row for each salt
        parts = entries(salted, "bucket", "salt").withColumn("keep_id", F.max("keep_id").over(whole)).withColumn("group_size", F.sum("group_size").over(whole))
        out = out.unionByName(parts.withColumn("text_sha256", F.sha2("_text", 256)).select(*names))
    return materialize(out.sortWithinPartitions("bucket", "hash"), "dedup-index")


def exact_dedup(docs: DataFrame, capacity: int | None = None, owner_rows: int | None = None, key: Callable[[Column], Column] = text_hash) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, whatever their hashes; null counts as empty, and texts of any
    length are compared whole. Of equal texts the largest doc_id stays. Rows that repeat both doc_id and text
    are one document and share its verdict; a group whose ids are all null keeps the null; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    rows = build_index(docs, capacity, owner_rows, key).select(F.explode("ids").alias("_of"), "keep_id", "group_size", "text_sha256")
    doc_id = F.col("_of.doc_id")
    return rows.select(doc_id.alias("doc_id"), "keep_id", "group_size", doc_id.eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def distinct_rows(docs: DataFrame, capacity: int | None = None, owner_rows: int | None = None, key: Callable[[Column], Column] = text_hash) -> DataFrame:
    """``docs`` with one row for each distinct text, the one with the largest doc_id, in the same columns.

    Rows meet at the owners of their buckets as for ``build_index``, where the entry keeps its largest row in
    place of ids. A null text and an empty one are copies. Rows that repeat doc_id and text, or whose ids are
    all null, are one row, the one with the largest values of the remaining columns in order, a text before a
    null one. An empty table gives none; columns may have any names.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.col("doc_id").alias("id"), F.col("text").isNotNull().alias("has"), *[named(c).alias(f"c{i}") for i, c in enumerate(rest)])
    one, many, any_hot = _routed(docs, key, capacity, owner_rows, row.alias("_row"))
    out = one.repartition("bucket").groupBy("bucket", "hash", "_text").agg(F.max("_row").alias("_row")).select("_text", "_row")
    if any_hot:  # the largest row needs no list of ids: map tasks shrink the copies before they travel
        out = out.unionByName(many.groupBy("bucket", "hash", "_text").agg(F.max("_row").alias("_row")).select("_text", "_row"))
    at = {c: F.col(f"_row.c{i}") for i, c in enumerate(rest)} | {"doc_id": F.col("_row.id"), "text": F.when(F.col("_row.has"), F.col("_text"))}
    return out.select(*[at[c].alias(c) for c in docs.columns])
