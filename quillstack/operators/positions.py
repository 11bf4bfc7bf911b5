"""Where runs of letters and digits stand, so that phrases find the notes that can have them without reading texts.

A phrase matches anywhere in a text, inside of words too: its first term may end a run and its last one may
begin one, while all terms between are runs of their own, one behind the other. That is what the join on
places finds; whether the phrase is really there is then tested on the texts of the notes found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.operators.dictionary import equal_to_some, starting_with, write_sorted
from quillstack.operators.expand import HEAD

RUN = r"[\p{L}\p{N}]+"


@dataclass
class Places:
    """runs: run, note_id, part (title or body, as written or folded), at (places in order). words: run, back (read backwards)."""

    runs: DataFrame
    words: DataFrame

    @classmethod
    def read(cls, spark, path: str) -> Places:
        return cls(spark.read.parquet(f"{path}/runs"), spark.read.parquet(f"{path}/run_words"))


def same_case(c: Column) -> Column:
    """Letters that differ in case only become one, as they are to a phrase."""
    return F.replace(F.lower(F.upper(c)), F.lit("ς"), F.lit("σ"))


def place_runs(notes: DataFrame) -> DataFrame:
    """run, note_id, part, at of every text that a phrase is tested on. A folded text is one of its own only where it can differ."""
    differs = lambda c: F.col(c).rlike(r"[^\x00-\x7F]|['’]")
    texts = [F.struct(F.lit(part).alias("part"), text.alias("text")) for part, text in (("t", F.col("title")), ("b", F.col("body")))]
    texts += [F.when(differs(c), F.struct(F.lit(part).alias("part"), tx.fold(c).alias("text"))) for part, c in (("tf", "title"), ("bf", "body"))]
    each = notes.select("note_id", F.explode(F.filter(F.array(*texts), lambda x: x.isNotNull())).alias("x"))
    found = each.select("note_id", "x.part", F.posexplode(F.regexp_extract_all(same_case(F.col("x.text")), F.lit(RUN), F.lit(0))).alias("i", "run"))
    return found.groupBy("run", "note_id", "part").agg(F.sort_array(F.collect_list("i")).alias("at"))  # of one text


def places_of(notes: DataFrame) -> Places:
    runs = place_runs(notes)
    return Places(runs, runs.select("run").distinct().withColumn("back", F.reverse("run")))


def store_places(notes: DataFrame, path: str) -> Places:
    """``places_of``, written: places in order of the run, words in order of their ends."""
    spark = notes.sparkSession
    write_sorted(place_runs(notes), f"{path}/runs", "run", "note_id")
    words = spark.read.parquet(f"{path}/runs").select("run").distinct().withColumn("back", F.reverse("run"))
    write_sorted(words, f"{path}/run_words", "back")
    return Places.read(spark, path)


def phrase_units(asked: DataFrame) -> DataFrame:
    """query_id, phrase, i, n, unit: the runs of each phrase of (query_id, phrases)."""
    runs = lambda terms: F.flatten(F.transform(terms, lambda t: F.regexp_extract_all(same_case(t), F.lit(RUN), F.lit(0))))
    each = asked.select("query_id", F.posexplode(F.transform("phrases", runs)).alias("phrase", "units"))
    return each.select("query_id", "phrase", F.size("units").alias("n"), F.posexplode("units").alias("i", "unit"))


def _beginning(units: DataFrame, words: DataFrame, column: str, some: list[str] | None) -> DataFrame:
    """The units with each run whose ``column`` begins with them."""
    if some is not None:
        words = words.where(starting_with(F.col(column), some))
    heads = F.array_distinct(F.array(*[F.substring(column, 1, n) for n in range(1, HEAD + 1)]))
    met = words.select("run", F.col(column).alias("_word"), F.explode(heads).alias("_head"))
    return units.withColumn("_head", F.substring("unit", 1, HEAD)).join(met, "_head").where(F.col("_word").startswith(F.col("unit"))).select("query_id", "phrase", "i", "n", "run")


def candidates(asked: DataFrame, places: Places, small: bool = False) -> DataFrame:
    """query_id, note_id: the notes in which all phrases of a query of (query_id, phrases) can be.

    small: whether the queries are few, so that their runs may pass the driver and tables are read no further than these reach.
    """
    units = phrase_units(asked.where(F.size("phrases") > 0))
    known = units.select("i", "n", "unit").distinct().collect() if small else None
    first = units.where("i = 0 and n > 1").withColumn("unit", F.reverse("unit"))
    last = units.where("i = n - 1 and n > 1")
    ends = [u["unit"][::-1] for u in known if u["i"] == 0] if small else None
    starts = [u["unit"] for u in known if u["i"] == u["n"] - 1] if small else None
    met = units.where("i > 0 and i < n - 1").select("query_id", "phrase", "i", "n", F.col("unit").alias("run"))
    met = met.unionByName(_beginning(first, places.words, "back", ends)).unionByName(_beginning(last, places.words, "run", starts))
    runs = places.runs
    if small:
        wide = [r["run"] for r in met.select("run").distinct().limit(10_000).collect()]
        runs = runs.where(equal_to_some(F.col("run"), wide)) if len(wide) < 10_000 else runs
    stood = met.join(runs, "run").select("query_id", "phrase", "i", "n", "note_id", "part", F.explode("at").alias("at"))
    whole = stood.groupBy("query_id", "phrase", "n", "note_id", "part", (F.col("at") - F.col("i")).alias("from")).agg(F.count(F.lit(1)).alias("met")).where("met = n")
    held = whole.select("query_id", "phrase", "note_id").distinct().groupBy("query_id", "note_id").agg(F.count(F.lit(1)).alias("held"))
    return held.join(asked.select("query_id", F.size("phrases").alias("all")), "query_id").where("held = all").select("query_id", "note_id")
