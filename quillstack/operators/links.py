"""Tags, wikilinks and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions import text as tx

# How tags and wikilinks are written.
TAG = r"(^|[\s(\[])#([\p{L}\p{N}][\p{L}\p{N}_/-]*)"
WIKILINK = r"\[\[([^\]|\n]+)(?:\|([^\]\n]*))?\]\]"
GRAPH_NODES, INVITATIONS = 90, 24


def blanked(body: Column, pattern: str) -> Column:
    """The text with every match turned into as many blanks."""
    gaps, found = F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit(" "), F.length(m)), F.lit("")))), "")


def without_code(body: Column) -> Column:
    """Fenced and inline code turned into blanks, so that offsets stay."""
    fenced = tx.let(blanked(body, r"(?s)```.*?(?:```|\z)"), lambda t: blanked(t, r"`[^`\n]*`"))
    return F.when(F.contains(body, F.lit("`")), fenced).otherwise(body)


def extract_tags(body: Column) -> Column:
    """Distinct folded tags with a letter, in order of appearance."""
    found = F.filter(F.regexp_extract_all(without_code(body), F.lit(TAG), F.lit(2)), lambda t: t.rlike(r"\p{L}"))
    tags = F.transform(found, lambda t: F.regexp_replace(tx.fold(t), r"/+\z", ""))
    return F.array_distinct(F.filter(tags, lambda t: t != ""))


def _links(clean: Column) -> Column:
    """target, key, label, start and end of each match of WIKILINK in a text without code."""
    of = lambda group: F.regexp_extract_all(clean, F.lit(WIKILINK), F.lit(group))
    gaps, sizes = (F.transform(x, F.length) for x in (F.split(clean, WIKILINK, -1), of(0)))
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda x, y: x + y)

    def link(p: Column, i: Column) -> Column:
        target, label = tx.trim(p["t"]), tx.trim(F.coalesce(p["l"], F.lit("")))
        start = total(gaps, i + 1) + total(sizes, i)
        return F.struct(target.alias("target"), tx.link_key(target).alias("key"), F.when(label == "", target).otherwise(label).alias("label"), start.alias("start"), (start + F.element_at(sizes, i + 1)).alias("end"))

    return F.filter(F.transform(F.arrays_zip(of(1).alias("t"), of(2).alias("l")), link), lambda x: x["target"] != "")


def extract_links(body: Column) -> Column:
    """target, key, label, start and end of each wikilink outside code, in order."""
    return tx.let(without_code(body), _links)


def extract_link_keys(body: Column) -> Column:
    """Distinct keys, in order of appearance."""
    targets = F.transform(F.regexp_extract_all(without_code(body), F.lit(WIKILINK), F.lit(1)), tx.trim)
    return F.array_distinct(F.transform(F.filter(targets, lambda t: t != ""), tx.link_key))


def title_keys(notes: DataFrame) -> DataFrame:
    """key, note_id: of the live notes with a title, the first in load order (latest update) claims it."""
    live = notes.where("trashed_at is null").select(tx.link_key(F.col("title")).alias("key"), F.struct((-F.col("updated_at")).alias("o"), "note_id").alias("first")).where("key <> ''")
    return live.groupBy("key").agg(F.min("first").alias("first")).select("key", F.col("first.note_id").alias("note_id"))


def link_targets(notes: DataFrame) -> DataFrame:
    """src, key, ord, dst of every link key of a live note; dst is null where no title answers."""
    out = notes.where("trashed_at is null").select(F.col("note_id").alias("src"), F.col("updated_at"), F.posexplode("links").alias("ord", "key"))
    return out.join(title_keys(notes).withColumnRenamed("note_id", "dst"), "key", "left")


def edges(notes: DataFrame) -> DataFrame:
    """src, dst: distinct resolved links between live notes, none to itself."""
    return link_targets(notes).where("dst is not null and dst <> src").select("src", "dst").distinct()


def unresolved(notes: DataFrame) -> DataFrame:
    """key, sources: link keys that no live title answers and how many notes use them."""
    return link_targets(notes).where("dst is null").groupBy("key").agg(F.count_distinct("src").alias("sources"))


def invitations(notes: DataFrame, most: int = INVITATIONS) -> DataFrame:
    """key, label: the first unresolved keys in load order, as their first note writes them."""
    missing = link_targets(notes).where("dst is null").groupBy("key").agg(F.min(F.struct((-F.col("updated_at")).alias("u"), F.col("src").alias("s"), F.col("ord").alias("i"))).alias("first"))
    first = missing.orderBy("first").limit(most)
    source = first.join(notes.select("note_id", "body"), F.col("first.s") == F.col("note_id"))
    named = source.withColumn("hit", F.try_element_at(F.filter(extract_links(F.col("body")), lambda x: x["key"] == F.col("key")), F.lit(1)))
    return named.select("key", F.coalesce("hit.target", "key").alias("label"))


def backlink_counts(edge: DataFrame) -> DataFrame:
    return edge.groupBy(F.col("dst").alias("note_id")).agg(F.count(F.lit(1)).alias("backlinks"))


def backlinks(notes: DataFrame, note_id: str) -> DataFrame:
    """The notes that link to one note."""
    return notes.join(edges(notes).where(F.col("dst") == note_id).select(F.col("src").alias("note_id")), "note_id", "left_semi")


def resolve(notes: DataFrame, title: str) -> DataFrame:
    """The note that a link to ``title`` leads to, if any."""
    key = F.lit(title)
    return notes.join(title_keys(notes).where(F.col("key") == tx.link_key(key)), "note_id", "left_semi")


def follow(notes: DataFrame, title: str, now: int, note_id: str) -> DataFrame:
    """``notes`` with a new note for ``title`` when no live note answers to it."""
    spark = notes.sparkSession
    row = spark.createDataFrame([(note_id, title, title + "\n", now, now, [], [], False, False, False, None, 1)], notes.schema)
    keyed = row.withColumn("_k", tx.link_key(F.col("title")))
    return notes.unionByName(keyed.join(title_keys(notes).select(F.col("key").alias("_k")), "_k", "left_anti").select(notes.columns))


def link_counts(notes: DataFrame) -> DataFrame:
    """note_id, link_count: own link keys plus notes that link to it."""
    back = backlink_counts(edges(notes))
    return notes.join(back, "note_id", "left").select("note_id", (F.size("links") + F.coalesce("backlinks", F.lit(0))).alias("link_count"))


def degrees(notes: DataFrame) -> DataFrame:
    """note_id, degree of each live, unarchived note."""
    e = edges(notes)
    ends = e.select(F.col("src").alias("note_id")).unionAll(e.select("dst")).groupBy("note_id").agg(F.count(F.lit(1)).alias("degree"))
    live = notes.where("trashed_at is null and not archived").select("note_id", "updated_at", "title")
    return live.join(ends, "note_id", "left").select("note_id", "updated_at", "title", F.coalesce("degree", F.lit(0)).alias("degree"))


def graph_nodes(notes: DataFrame, most: int = GRAPH_NODES) -> DataFrame:
    """The best-connected notes, the latest first among equals, with their labels."""
    top = degrees(notes).orderBy(F.desc("degree"), F.desc("updated_at"), "note_id").limit(most)
    return top.withColumn("label", tx.graph_label(F.col("title")))


def graph_edges(notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    kept = nodes.select("note_id")
    return edges(notes).join(kept.withColumnRenamed("note_id", "src"), "src", "left_semi").join(kept.withColumnRenamed("note_id", "dst"), "dst", "left_semi").select("src", "dst")


def graph_stats(notes: DataFrame, most: int = GRAPH_NODES) -> DataFrame:
    """connected, shown, hidden and edges of the drawn graph."""
    nodes = graph_nodes(notes, most)
    e = graph_edges(notes, nodes)
    linked = e.select("src").union(e.select("dst")).agg(F.count_distinct("src").alias("connected"))
    total = notes.where("trashed_at is null and not archived").agg(F.count(F.lit(1)).alias("live"))
    shown = nodes.agg(F.count(F.lit(1)).alias("shown"))
    one = e.agg(F.count(F.lit(1)).alias("edges"))
    out = linked.join(total).join(shown).join(one)  # a row each
    return out.select("connected", "shown", (F.col("live") - F.col("shown")).alias("hidden"), "edges")


def orphans(notes: DataFrame) -> DataFrame:
    """Live notes without a link in either direction."""
    return notes.where("trashed_at is null").join(link_counts(notes).where("link_count = 0"), "note_id", "left_semi").select("note_id")


def tag_tree(notes: DataFrame) -> DataFrame:
    """path, parent, name, depth, notes: every tag and ancestor with the live notes below it, each counted once."""
    tags = notes.where("trashed_at is null").select("note_id", F.explode("tags").alias("tag")).select("note_id", F.split("tag", "/").alias("p"))
    paths = tags.select("note_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", F.lit(1), i), "/"))).alias("path"))
    counted = paths.distinct().groupBy("path").agg(F.count(F.lit(1)).alias("notes"))
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*\z", ""))
    return counted.select("path", parent.alias("parent"), F.substring_index("path", "/", -1).alias("name"), F.size(F.split("path", "/")).alias("depth"), "notes")


def tag_tree_order(tree: DataFrame) -> DataFrame:
    """The tree with each node's place among its siblings: more notes first, then by name."""
    return tree.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("notes"), "name")))


def library_counts(notes: DataFrame) -> DataFrame:
    gone = F.col("trashed_at").isNotNull()
    return notes.agg(
        F.count_if(~gone & ~F.col("archived")).alias("active"), F.count_if(~gone & F.col("archived")).alias("archived"), F.count_if(gone).alias("trashed")
    )


def title_suggestions(notes: DataFrame, queries: list[tuple[str, str]], most: int = 8) -> DataFrame:
    """query_id, place, note_id, title: titles that start with the text, then those that hold it, latest first."""
    spark = notes.sparkSession
    asked = spark.createDataFrame([(i, q.strip().lower()) for i, q in queries], "query_id string, q string")
    live = notes.where("trashed_at is null").where(tx.trim(F.col("title")) != "").select("note_id", "title", "updated_at", F.lower("title").alias("t"))
    # Every title is tried against every query; the queries are the caller's list.
    met = live.join(F.broadcast(asked), F.col("t").contains(F.col("q")))
    rank = F.when(F.col("q") == "", 2).when(F.col("t").startswith(F.col("q")), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(rank, F.desc("updated_at"), "note_id"))
    return met.withColumn("place", place).where(F.col("place") <= most).select("query_id", "place", "note_id", "title")


def sort_notes(notes: DataFrame, key: str = "updated", ascending: bool = False, collation: str | None = None) -> DataFrame:
    """Pinned first, then by title, created or updated; ties by id. Titles are in order of their bytes, or as a
    collation (UNICODE, de, fr_CI and so on) has them."""
    col = F.col({"title": "title", "created": "created_at", "updated": "updated_at"}[key])
    col = F.collate(col, collation) if key == "title" and collation else col
    return notes.orderBy(F.desc("pinned"), col.asc() if ascending else col.desc(), "note_id")
