"""The words of an index in the orders in which searches look them up.

``vocab`` (term, df, stem) is stored in order of the term, ``stems`` (stem, term) by stem and ``grams`` (gram,
size, term) by gram and the term's length, each cut into ranges by that order. A lookup with the values at
hand names the intervals that it needs, so that files, row groups and pages outside of them aren't read.
Naming them only saves reading: the joins that follow decide.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import text as tx

#: Most intervals that a lookup names. More values share wider ones.
INTERVALS = 64
#: Bytes of a row group of the stored tables, so that a lookup reads little beside what it needs.
ROW_GROUP = 1 << 20


@dataclass
class Words:
    """vocab: term, df, stem. stems: stem, term, where they differ. grams: gram, size, term. stale: whether stems
    and grams may have terms that the vocabulary has lost."""

    vocab: DataFrame
    stems: DataFrame
    grams: DataFrame
    stale: bool = False

    @classmethod
    def of(cls, vocab: DataFrame) -> Words:
        return cls(vocab, stems_of(vocab), grams_of(vocab))


def stems_of(vocab: DataFrame) -> DataFrame:
    return vocab.where("stem <> term").select("stem", "term")


def grams_of(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.explode(tx.trigrams(F.col("term"))).alias("gram"), F.length("term").alias("size"), "term")


def write_sorted(rows: DataFrame, path: str, *order: str, by_range: bool = True) -> None:
    """Parquet in order, in ranges of it unless there are few rows, with small row groups."""
    rows = rows.repartitionByRange(*order) if by_range else rows.coalesce(1)
    rows.sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)


def prefix_end(prefix: str) -> str | None:
    """The least string above all that start with ``prefix``; None if there is none."""
    last = ord(prefix[-1])
    if last == 0x10FFFF:
        return prefix_end(prefix[:-1]) if len(prefix) > 1 else None
    return prefix[:-1] + chr(0xE000 if last == 0xD7FF else last + 1)


def _any(rules: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, rules) if rules else F.lit(False)


def starting_with(column: Column, prefixes: list[str], most: int = INTERVALS) -> Column:
    """Whether a value is in one of at most ``most`` intervals that hold all values with one of these prefixes."""
    heads, size = sorted(set(prefixes)), max(map(len, prefixes), default=1)
    while len(heads) > most and size > 1:
        size -= 1
        heads = sorted({p[:size] for p in prefixes})
    heads = [h for i, h in enumerate(heads) if not any(h.startswith(g) for g in heads[:i])]
    if len(heads) > most:
        heads = [heads[0], heads[-1]]
        return (column >= heads[0]) & ((column < end) if (end := prefix_end(heads[1])) else F.lit(True))
    return _any([(column >= h) & (column < end) if (end := prefix_end(h)) else column >= h for h in heads])


def equal_to_some(column: Column, values: list[str], most: int = INTERVALS) -> Column:
    """Whether a value may be one of these: exactly so for at most ``most`` of them."""
    return _any([column == v for v in sorted(set(values))]) if len(set(values)) <= most else starting_with(column, values, most)
