"""Tokenising, folding, stemming and other text functions as native Column expressions.

Offsets and lengths count code points. ``*_sql`` helpers give expressions that DuckDB reads too.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstack.types import kind

#: A word: apostrophes and underscores belong to it between letters and digits.
WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}'’_]*[\p{L}\p{N}])?"
COUNTED_WORD = r"[\p{L}\p{N}'’_-]+"
#: White space as the query language understands it, beyond ASCII too.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
OPEN_TASK, DONE_TASK = r"(?m)^\s*[-*]\s+\[ \]", r"(?m)^\s*[-*]\s+\[[xX]\]"


def fold_text(s: str) -> str:
    """Lower case without accents and apostrophes: decompose, drop U+0300 to U+036F, drop ' and ’, lower."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ" and c not in "'’").lower()


def _fold_rules() -> tuple[str, str, str]:
    """Characters and what they become by ``fold_text`` short of lower-casing; the pattern of those that become several."""
    one_from, one_to, many = [], [], []
    for cp in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x11000, 0x12000), *range(0x1D100, 0x1D200), *range(0x2F800, 0x2FA20)]:
        c = chr(cp)
        d = unicodedata.normalize("NFD", c)
        if d == c or 0x300 <= cp <= 0x36F:
            continue
        rest = "".join(x for x in d if not "̀" <= x <= "ͯ")
        if len(rest) == 1 and cp < 0x3000:
            one_from.append(c)
            one_to.append(rest)
        else:
            many.append(cp)
    runs: list[list[int]] = []
    for cp in many:
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    dropped = [chr(x) for x in range(0x300, 0x370)] + ["'", "’"]  # translate drops what has no partner
    return "".join(one_from + dropped), "".join(one_to), "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


_FROM, _TO, MANY = _fold_rules()


def fold(c: Column | str) -> Column:
    """``fold_text`` inside the JVM, exact for texts for which ``folds_oddly`` is false. ASCII needs no table."""
    c = c if isinstance(c, Column) else F.col(c)
    plain = (F.octet_length(c) == F.char_length(c)) & ~F.contains(c, F.lit("'"))
    return F.lower(F.when(plain, c).otherwise(F.translate(c, _FROM, _TO)))


def folds_oddly(c: Column) -> Column:
    """Whether a text has a character of MANY; the long list is only tried where its range occurs at all."""
    return c.rlike(r"[\x{600}-\x{10FFFF}]") & c.rlike(MANY)


def folds_by_word(c: Column) -> Column:
    """Whether the words of a folded text may not be its folded words: with letters of MANY, with combining marks, which
    part words before they go, or with a capital sigma, whose lower case depends on what follows."""
    return c.rlike(r"[\x{300}-\x{36F}\x{3A3}\x{600}-\x{10FFFF}]") & (c.rlike(r"[\x{300}-\x{36F}\x{3A3}]") | c.rlike(MANY))


@F.pandas_udf(kind("string"))
def fold_udf(s: pd.Series) -> pd.Series:
    """``fold_text`` for the rare terms with a character of MANY."""
    return s.map(fold_text, na_action="ignore")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def raw_words(c: Column) -> Column:
    """Words in order."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


#: Boundaries inside a word, each written as what stands on its two sides.
BOUNDARIES = [r"([a-z])([A-Z])", r"([A-Z])([A-Z][a-z])", r"([0-9])([^0-9 ])", r"([^0-9 ])([0-9])"]


#: What every compound word has somewhere.
HAS_BOUNDARY = r"[a-z][A-Z]|[A-Z][A-Z][a-z]|[0-9_'’]"


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _split(word: Column) -> Column:
    w = F.regexp_replace(word, r"[_'’]", " ")
    for b in BOUNDARIES:
        w = F.regexp_replace(w, b, "$1 $2")
    return F.filter(F.split(w, " "), lambda x: x != "")


def compound_parts(word: Column) -> Column:
    """Parts of a word at camel-case, acronym and digit edges and at _ ' ’; empty unless there are several."""
    none = F.array().cast("array<string>")
    return F.when(word.rlike(HAS_BOUNDARY), let(_split(word), lambda parts: F.when(F.size(parts) > 1, parts).otherwise(none))).otherwise(none)


def with_parts(word: Column) -> Column:
    """The word, followed by its compound parts. Most words have no boundary and cost one look for it."""
    alone = F.array(word)
    return F.when(word.rlike(HAS_BOUNDARY), let(_split(word), lambda parts: F.when(F.size(parts) > 1, F.concat(alone, parts)).otherwise(alone))).otherwise(alone)


def _ends(s: Column, *tails: str) -> Column:
    out = F.lit(False)
    for t in tails:
        out = out | s.endswith(t)
    return out


def _cut(s: Column, n: int) -> Column:
    return F.substring(s, F.lit(1), F.length(s) - n)


def _restored(s: Column) -> Column:
    last, second = F.right(s, F.lit(1)), F.substring(s, F.length(s) - 1, F.lit(1))
    doubled = (last == second) & ~last.isin("a", "e", "i", "o", "u", "l", "s", "z")
    return F.when(F.length(s) < 3, s).when(doubled, _cut(s, 1)).when(_ends(s, "at", "bl", "iz", "v", "u"), F.concat(s, F.lit("e"))).otherwise(s)


def stem(word: Column) -> Column:
    """A gentle suffix stripper: plurals, then -ing, -edly and -ed with their spelling changes, then -ly, -ment and -ness."""
    n = F.length

    def plural(s):
        return (
            F.when(_ends(s, "ies") & (n(s) > 4), F.concat(_cut(s, 3), F.lit("y")))
            .when(_ends(s, "sses"), _cut(s, 2))
            .when(_ends(s, "ses") & (n(s) > 4), _cut(s, 2))
            .when(_ends(s, "xes", "zes", "ches", "shes"), _cut(s, 2))
            .when(_ends(s, "s") & ~_ends(s, "ss", "us", "is"), _cut(s, 1))
            .otherwise(s)
        )

    def verbal(s):
        return (
            F.when(_ends(s, "ing") & (n(s) > 5), let(_cut(s, 3), _restored))
            .when(_ends(s, "edly") & (n(s) > 6), let(_cut(s, 4), _restored))
            .when(_ends(s, "ed") & (n(s) > 4), let(_cut(s, 2), _restored))
            .otherwise(s)
        )

    def without(tail, least):
        return lambda s: F.when(_ends(s, tail) & (n(s) > least), _cut(s, len(tail))).otherwise(s)

    out = let(let(word, plural), verbal)
    for tail, least in (("ly", 4), ("ment", 6), ("ness", 6)):
        out = let(out, without(tail, least))
    return F.when(n(word) <= 3, word).otherwise(out)


def trigrams(term: Column) -> Column:
    padded = F.concat(F.lit("  "), term, F.lit(" "))
    return let(padded, lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))))


def max_edits(term: Column) -> Column:
    return F.when(F.length(term) <= 3, 0).when(F.length(term) <= 5, 1).otherwise(2)


def link_key(title: Column) -> Column:
    return trim(F.regexp_replace(fold(title), rf"{SPACE}+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(COUNTED_WORD))


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words / 220 + 0.5)).cast("int")


def derive_title(body: Column, fallback: str = "") -> Column:
    """The first line that isn't blank without its heading, task, bullet or quote marker, at most 120 characters."""
    t = F.try_element_at(F.filter(F.transform(F.split(body, "\n"), trim), lambda x: x != ""), F.lit(1))
    for pattern in (r"^#{1,6}\s+", r"^[-*]\s+\[[ xX]\]\s*", r"^[-*>]\s+"):
        t = F.regexp_replace(t, pattern, "")
    t = F.substring(trim(F.regexp_replace(t, r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", "$1")), 1, 120)
    return F.when(t.isNull() | (t == ""), F.lit(fallback)).otherwise(t)


# What a preview drops from its lines, in order, and what stays of it.
PREVIEW_MARKERS = ((r"^#{1,6}\s+", ""), (r"^\s*[-*]\s+\[[ xX]\]\s*", ""), (r"^\s*[-*>]\s+", ""), (r"[*_`]", ""), (r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", r"\1"))


def preview(body: Column, most: int = 180) -> Column:
    """The text below the title line on one line, without markers, cut with an ellipsis."""

    def from_first(lines: Column, skip: int) -> Column:
        at = F.array_position(F.transform(lines, lambda x: trim(x) != ""), True).cast("int")
        return F.when(at == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, at + skip, F.size(lines)))

    below = let(let(F.split(body, "\n"), lambda x: from_first(x, 1)), lambda x: from_first(x, 0))
    rest = F.array_join(below, "\n")
    for pattern, to in PREVIEW_MARKERS:
        rest = F.regexp_replace(rest, "(?m)" + pattern, to.replace("\\", "$"))
    flat = trim(F.regexp_replace(trim(rest), r"\s*\n\s*", "  "))
    cut = F.concat(F.regexp_replace(F.substring(flat, 1, most), rf"{SPACE}+\z", ""), F.lit("…"))
    return F.when(F.length(flat) > most, cut).otherwise(flat)


def phrase_pattern(terms: list[str]) -> str:
    """A pattern for the terms in order with only punctuation or blanks between them, case aside, anywhere in a word."""
    return "(?iu)" + r"[^\p{L}\p{N}]+".join(terms)


def recency_boost(updated_at: Column, now: int) -> Column:
    days = F.greatest(F.lit(0.0), (F.lit(now) - updated_at) / F.lit(864e5))
    return 1 + 0.28 / (1 + days / 21)


def inverse_frequency(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def relative_time(at: Column, now: int) -> Column:
    """now, Nm, Nh, a weekday within the week, else day and month, with the year where it differs."""
    minutes = F.floor((F.lit(now) - at) / 60_000)
    when = F.timestamp_millis(at)
    this_year = F.year(F.timestamp_millis(F.lit(now)))
    return (
        F.when(minutes < 1, "now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h")))
        .when(minutes < 7 * 1440, F.date_format(when, "EEE"))
        .when(F.year(when) == this_year, F.date_format(when, "d MMM"))
        .otherwise(F.date_format(when, "d MMM yyyy"))
    )


def full_time(at: Column) -> Column:
    return F.date_format(F.timestamp_millis(at), "d MMM, HH:mm")


def graph_label(title: Column) -> Column:
    """Up to 20 characters as they are; else the first 19, cut back to a whole word where there is one, and an ellipsis."""
    full = F.when(trim(title) == "", F.lit("Untitled")).otherwise(trim(title))
    cut = F.regexp_replace(F.substring(full, 1, 19), r"\s+\S*\z", "")
    return F.when(F.length(full) <= 20, full).otherwise(F.concat(cut, F.lit("…")))


def marked_segments(text: Column, ranges: Column) -> Column:
    """Alternating plain and marked segments: array of (text, marked), from sorted ranges (start, end)."""
    n = F.size(ranges)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(ranges, i)["end"])

    def pair(r: Column, i: Column) -> Column:
        plain = F.struct(F.substring(text, before(i) + 1, r["start"] - before(i)).alias("text"), F.lit(False).alias("marked"))
        return F.array(plain, F.struct(F.substring(text, r["start"] + 1, r["end"] - r["start"]).alias("text"), F.lit(True).alias("marked")))

    tail = F.struct(F.substring(text, F.when(n > 0, F.try_element_at(ranges, n)["end"]).otherwise(F.lit(0)) + 1, F.length(text)).alias("text"), F.lit(False).alias("marked"))
    return F.filter(F.concat(F.flatten(F.transform(ranges, pair)), F.array(tail)), lambda x: x["text"] != "")
