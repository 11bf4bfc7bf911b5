"""How the sources of a language differ in their words: an audit of term shares, exact in whole numbers.

A term's share in a group (language, source) is 1 + floor(10^9 * (count + 5) / (N + 5 V)), over the V terms
that enough documents of the language have. Two reports follow from these shares.

* Terms that a source has more of than its language, the ``most`` with the largest excess. The cut is found by
  radix select: histograms over a few bits of the excess at a time, from the highest on, tell for all groups
  at once in which cell the last place falls, until its exact value is known. Terms that tie there are cut
  by the bytes of their UTF-8 in the same way, a byte at a time. Only what is reported is sorted.
* Pairs of sources, by the sum of the differences of their shares. A term that neither has adds the same to
  each pair: the difference of the two baselines, the share of a term that doesn't occur. So only occurring
  terms are looked at, each for what it adds beyond the baselines: alone, from a histogram of a source's
  shares, which are as many as its different counts, and together, where two sources have the same term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import empty_text, materialize

#: What stands between terms: all ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCUMENTS, MOST_TERMS = 30, 50
SCALE, SMOOTHING = 1_000_000_000, 5
#: Bits of a value told apart by one histogram, and how many values have (shares are below 2^30 + 2).
DIGIT_BITS, VALUE_BITS = 11, 33
#: Ties of a group up to this number are sorted at once; beyond, they are cut by a further byte.
FEW_TIES = 4096

GROUP = ["lang", "source"]
_WIDE = "decimal(38,0)"


def terms_of(text: Column) -> Column:
    """The terms of a text in order, A to Z in lower case."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (N + 5 V)), null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = (wide(count) + SMOOTHING) * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(terms > 0, 1 + F.call_function("div", above, wide(total) + wide(terms) * SMOOTHING))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""
    rows = docs.select(*[empty_text(c).alias(c) for c in GROUP], F.sort_array(terms_of(empty_text())).alias("t"))
    each = rows.select(*GROUP, "t", F.posexplode("t").alias("i", "term"))
    first = F.coalesce(F.get("t", F.col("i") - 1) != F.col("term"), F.lit(True)).cast("int")  # of its document
    return each.groupBy(*GROUP, "term").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("docs"))


def term_shares(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Shares of the kept terms that occur: lang, source, term, p, q (of the language), base (of a term that
    doesn't occur in the source). And the groups: lang, source, terms, base."""
    counts = materialize(term_counts(docs), "audit-counts")
    term = Window.partitionBy("lang", "term")  # a row a source
    kept = counts.withColumn("everywhere", F.sum("docs").over(term)).where(F.col("everywhere") >= least_documents)
    kept = kept.select(*GROUP, "term", "n", F.sum("n").over(term).alias("n_lang"), (F.row_number().over(term.orderBy("source")) == 1).cast("long").alias("one"))
    kept = materialize(kept, "audit-kept")
    totals = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.sum("one").alias("ones"))
    groups = docs.select(*[empty_text(c).alias(c) for c in GROUP]).distinct().join(totals, GROUP, "left").na.fill(0)
    lang = Window.partitionBy("lang")  # a row a source
    groups = groups.select(*GROUP, "total", F.sum("total").over(lang).alias("lang_total"), F.sum("ones").over(lang).alias("terms"))
    groups = materialize(groups.withColumn("base", share(F.lit(0), F.col("total"), F.col("terms"))), "audit-groups")
    rows = kept.join(groups, GROUP)
    shares = rows.select(*GROUP, "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("n_lang"), F.col("lang_total"), F.col("terms")).alias("q"), "base")
    return materialize(shares, "audit-shares"), groups.select(*GROUP, "terms", "base")


def pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the summed differences of their shares."""
    one, two = (groups.select("lang", F.col("source").alias(s), F.col("terms").alias(f"terms_{s}"), F.col("base").alias(f"base_{s}")) for s in "ab")
    gap = F.abs(F.col("base_a") - F.col("base_b"))
    neither = one.join(two, "lang").where("a < b").select("lang", "a", "b", F.coalesce(F.col("terms_a") * gap, F.lit(0)).alias("part"))
    levels = shares.groupBy(*GROUP, "p", "base").agg(F.count(F.lit(1)).alias("n"))  # a source has few different counts
    alone = levels.select("lang", F.col("source").alias("a"), "p", F.col("base").alias("base_a"), "n").join(two, "lang").where("a <> b")
    alone = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("n") * (F.abs(F.col("p") - F.col("base_b")) - gap)).alias("part"))
    left, right = (shares.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p_{s}"), F.col("base").alias(f"base_{s}")) for s in "ab")
    apart = F.abs(F.col("p_a") - F.col("p_b")) - F.abs(F.col("p_a") - F.col("base_b")) - F.abs(F.col("p_b") - F.col("base_a")) + gap
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", apart.alias("part"))
    sums = neither.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    return sums.select("lang", ends, "value").select("lang", "x.source", "x.item", "value")


def _cells(rows: DataFrame, cell: Column, order: Column) -> DataFrame:
    """For each group the cell in which its last place falls: the group, cell, need (places left for it) and n (rows in it).

    rows: the group and need. A group with fewer rows than places ends in its last cell.
    """
    sizes = rows.groupBy(*GROUP, cell.alias("cell")).agg(F.max("need").alias("need"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*GROUP).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = sizes.withColumn("before", before).where("before < need")
    last = open_.groupBy(*GROUP).agg(F.max_by(F.struct("cell", (F.col("need") - F.col("before")).alias("need"), "n"), "before").alias("x"))
    return last.select(*GROUP, "x.cell", "x.need", "x.n")


def top_items(rows: DataFrame, most: int = MOST_TERMS, few_ties: int = FEW_TIES) -> DataFrame:
    """The ``most`` rows of each group (lang, source) with the largest value, ties to the smaller item: by radix select.

    rows: lang, source, item (distinct in its group), value (from 0 to below 2^33).
    """
    cut = None
    for shift in range(VALUE_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        value = F.shiftright("value", shift)
        if cut is None:
            met = rows.withColumn("need", F.lit(most))
        else:
            met = rows.join(cut, GROUP).where(F.shiftright("value", shift + DIGIT_BITS) == F.col("cell"))
        cut = materialize(_cells(met, value, F.desc("cell")).drop("n"), "audit-cut")
    bounded = rows.join(cut, GROUP)
    above = bounded.where(F.col("value") > F.col("cell")).select(*rows.columns)
    ties = materialize(bounded.where(F.col("value") == F.col("cell")).select(*rows.columns, F.col("item").cast("binary").alias("bytes"), "need"), "audit-ties")
    start = F.substring("bytes", F.lit(1), F.octet_length("cell"))
    cut = materialize(ties.groupBy(*GROUP).agg(F.max("need").alias("need"), F.count(F.lit(1)).alias("n")).withColumn("cell", F.lit(b"")), "audit-bytes")
    while not (many := cut.where((F.col("n") > few_ties) & (F.col("n") > F.col("need")))).isEmpty():
        met = ties.drop("need").join(many.select(*GROUP, "cell", "need"), GROUP).where(start == F.col("cell"))
        longer = _cells(met.select(*GROUP, F.substring("bytes", F.lit(1), F.octet_length("cell") + 1).alias("longer"), "need"), F.col("longer"), F.asc("cell"))
        cut = materialize(longer.unionByName(cut.join(many, GROUP, "left_anti"), allowMissingColumns=True), "audit-bytes")
    ties = ties.drop("need").join(cut.select(*GROUP, "cell", "need"), GROUP)
    below = ties.where(start < F.col("cell")).select(*rows.columns)
    nth = F.row_number().over(Window.partitionBy(*GROUP).orderBy("bytes"))  # few_ties rows at most, or all of which are taken
    level = ties.where(start == F.col("cell")).withColumn("nth", nth).where(F.col("nth") <= F.col("need")).select(*rows.columns)
    return above.unionByName(below).unionByName(level)


def source_divergence(docs: DataFrame, most_terms: int = MOST_TERMS, least_documents: int = LEAST_DOCUMENTS, few_ties: int = FEW_TIES) -> DataFrame:
    """lang, source, part, item, value, rank: what sets the sources of each language of ``docs`` (text, lang, source) apart.

    Part ``pair`` has a row for every other source of the language, ``term`` for the terms that a source has
    most in excess of its language. Null texts, languages and sources are read as empty; texts of any length
    are read whole; rows that repeat count each; a group without terms still has its pairs, whose value is 0
    if the language has no kept term; an empty table gives no rows; other columns are ignored, whatever
    their names. What is gathered by group are its pairs, one for each other source, and its reported terms.
    """
    shares, groups = term_shares(docs, least_documents)
    more = shares.where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    parts = {"pair": pair_sums(shares, groups), "term": top_items(materialize(more, "audit-more"), most_terms, few_ties)}
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    ranked = [rows.select(*GROUP, F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank.alias("rank")) for part, rows in parts.items()]
    return ranked[0].unionByName(ranked[1])
