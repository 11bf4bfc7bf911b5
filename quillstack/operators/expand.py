"""Expansion of query terms into surface forms of the vocabulary, each with a confidence.

All layers are joins between the batch's terms and the tables of ``dictionary.Words``; nothing of the batch
is on the driver. Only where a batch has few words the caller may know them (``words``), and the tables are
then read no further than these words can reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.functions.fuzzy import osa_udf
from quillstack.operators.dictionary import Words, equal_to_some, starting_with
from quillstack.scratch import new_folder

# Confidences and limits of the layers.
STEM, PREFIX, PREFIX_POWER, FUZZY, PARTS, JOINED = 0.85, 0.7, 0.35, 0.55, 0.75, 0.9
PREFIX_MOST, PREFIX_SEEN, FUZZY_MOST = 24, 192, 12
#: Characters of a prefix by which it meets the vocabulary; what follows them is compared.
HEAD = 3


def settled(rows: DataFrame, small: bool, label: str) -> DataFrame:
    """``rows`` as they are now: a local table if the caller knows them to be few, else a written one."""
    spark = rows.sparkSession
    if small:
        return spark.createDataFrame(rows.collect(), rows.schema)
    path = new_folder(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def wanted(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """use, term, i, surface: what the layers look up as it is. Uses: the term itself, its stem, the halves of
    every split into two of three letters at least, and the term joined with the next one. terms: the distinct ones."""
    use = lambda name, at, surface: F.struct(F.lit(name).alias("use"), at.cast("string").alias("i"), surface.alias("surface"))
    cuts = F.when(F.length("term") >= 6, F.sequence(F.lit(3), F.length("term") - 3)).otherwise(F.array().cast("array<int>"))
    halves = F.flatten(F.transform(cuts, lambda n: F.array(use("head", n, F.substring("term", F.lit(1), n)), use("tail", n, F.substring("term", n + 1, F.length("term"))))))
    whole = F.array(use("self", F.lit(None), F.col("term")), use("stem", F.lit(None), tx.stem(F.col("term"))))
    own = terms.select("term", F.explode(F.concat(whole, halves)).alias("u"))
    pairs = asked.where("next is not null").select("term", "next").distinct().select("term", use("pair", F.col("next"), F.concat("term", "next")).alias("u"))
    return own.unionByName(pairs).select("u.use", "term", "u.i", "u.surface")


def kin_layer(terms: DataFrame, tables: Words, stems: list[str] | None = None) -> DataFrame:
    """All words that reduce to the term's stem."""
    table = tables.stems if stems is None else tables.stems.where(equal_to_some(F.col("stem"), stems))
    return terms.select("term", tx.stem(F.col("term")).alias("stem")).join(table.select("stem", F.col("term").alias("surface")), "stem").select("term", "surface", F.lit(STEM).alias("weight"))


def prefix_layer(terms: DataFrame, tables: Words, words: list[str] | None = None) -> DataFrame:
    """Completions: the first PREFIX_SEEN in order, of which the shortest PREFIX_MOST.

    Terms meet the sorted vocabulary by their first HEAD characters, or all if they have fewer.
    """
    table = tables.vocab if words is None else tables.vocab.where(starting_with(F.col("term"), words))
    cuts = range(1, HEAD + 1) if words is None else sorted({min(len(w), HEAD) for w in words})
    heads = F.array(*[F.substring("surface", 1, n) for n in cuts])
    found = table.select(F.col("term").alias("surface")).select("surface", F.explode(F.array_distinct(heads)).alias("head"))
    met = terms.select("term", F.substring("term", 1, HEAD).alias("head")).join(found, "head")
    met = met.where(F.col("surface").startswith(F.col("term")) & (F.length("surface") > F.length("term")))
    first = F.row_number().over(Window.partitionBy("term").orderBy("surface"))
    met = met.withColumn("i", first).where(F.col("i") <= PREFIX_SEEN)
    short = F.row_number().over(Window.partitionBy("term").orderBy(F.length("surface"), "surface"))
    met = met.withColumn("j", short).where(F.col("j") <= PREFIX_MOST)
    return met.select("term", "surface", (PREFIX * F.pow(F.length("term") / F.length("surface"), F.lit(PREFIX_POWER))).alias("weight"))


def near_terms(terms: DataFrame, tables: Words, words: list[str] | None = None) -> DataFrame:
    """term, surface, distance: vocabulary within the edit budget that shares enough trigrams, the nearest FUZZY_MOST."""
    asked = terms.select("term", tx.max_edits(F.col("term")).alias("budget"), tx.trigrams(F.col("term")).alias("g")).where("budget > 0")
    grams = asked.select("term", "budget", F.greatest(F.lit(1), F.size("g") - 3 * F.col("budget")).alias("needed"), F.explode("g").alias("gram"))
    table = tables.grams
    if words is not None:
        padded = [f"  {w} " for w in words]
        table = table.where(equal_to_some(F.col("gram"), [p[i : i + 3] for p in padded for i in range(len(p) - 2)]))
        table = table.where(F.col("size").between(min(map(len, words), default=0) - 2, max(map(len, words), default=0) + 2))
    shared = table.withColumnRenamed("term", "surface").join(grams, "gram").where(F.abs(F.col("size") - F.length("term")) <= F.col("budget"))
    some = shared.groupBy("term", "surface", "budget", "needed").agg(F.count(F.lit(1)).alias("shared")).where("shared >= needed and surface <> term")
    near = some.where(F.levenshtein("term", "surface") <= 2 * F.col("budget"))  # a swap is two plain edits
    near = near.withColumn("distance", osa_udf("term", "surface", "budget")).where("distance <= budget")
    if tables.stale:
        near = near.join(tables.vocab.select(F.col("term").alias("surface")), "surface", "left_semi")
    place = F.row_number().over(Window.partitionBy("term").orderBy("distance", "surface"))
    return near.withColumn("i", place).where(F.col("i") <= FUZZY_MOST).select("term", "surface", "distance")


def parts_layer(met: DataFrame) -> DataFrame:
    """The first split into two known words, from what was looked up."""
    halves = [met.where(F.col("use") == use).select("term", F.col("i").cast("int").alias("i"), F.col("surface").alias(k)) for use, k in (("head", "a"), ("tail", "b"))]
    first = halves[0].join(halves[1], ["term", "i"]).groupBy("term").agg(F.min(F.struct("i", "a", "b")).alias("s"))
    return first.select("term", F.explode(F.array("s.a", "s.b")).alias("surface"), F.lit(PARTS).alias("weight"))


def expand(asked: DataFrame, tables: Words, words: list[str] | None = None) -> DataFrame:
    """query_id, i, surface, weight from (query_id, i, term, next): the best weight of each surface of each term.

    words: the distinct terms, if they are few and the caller has them. What is looked up as it is comes
    first, in one join with the vocabulary; typos and splits are only for terms that it doesn't know.
    """
    small, spark = words is not None, asked.sparkSession
    of_words = lambda some: spark.createDataFrame([(w,) for w in some], "term string")
    terms = of_words(words) if small else asked.select("term").distinct()
    want, known = wanted(asked, terms), tables.vocab.select(F.col("term").alias("surface"))
    lost = stems = None
    if small:  # as many rows as the words have letters
        rows = want.collect()
        want, stems = spark.createDataFrame(rows, want.schema), sorted({r["surface"] for r in rows if r["use"] == "stem"})
        known = known.where(equal_to_some(F.col("surface"), [r["surface"] for r in rows]))
    met = settled(want.join(known, "surface"), small, "expand-met")
    own = met.where(F.col("use") == "self").select("term")
    if small:
        lost = sorted(set(words) - {r["term"] for r in own.collect()})
    unknown = of_words(lost) if small else terms.join(own, "term", "left_anti")
    exact = own.select("term", F.col("term").alias("surface"), F.lit(1.0).alias("weight"))
    stem = met.where(F.col("use") == "stem").select("term", "surface", F.lit(STEM).alias("weight"))
    layers = exact.unionByName(stem).unionByName(kin_layer(terms, tables, stems)).unionByName(prefix_layer(terms, tables, words))
    if lost is None or lost:
        layers = layers.unionByName(parts_layer(met.join(unknown, "term", "left_semi")))
        layers = layers.unionByName(near_terms(unknown, tables, lost).select("term", "surface", (FUZZY / F.col("distance")).alias("weight")))
    of_terms = asked.join(layers, "term").select("query_id", "i", "surface", "weight")
    pairs = met.where(F.col("use") == "pair").select("term", F.col("i").alias("next"), "surface")
    joined = asked.join(pairs, ["term", "next"]).select("query_id", F.explode(F.array("i", F.col("i") + 1)).alias("i"), "surface", F.lit(JOINED).alias("weight"))
    return of_terms.unionByName(joined).groupBy("query_id", "i", "surface").agg(F.max("weight").alias("weight"))
