"""Secret scanning with corpus-wide ownership frequency.

Patterns find candidates: assignments to secret names, access keys, long hex runs and tokens of known
shape. Each candidate's value is hashed where it is found, so that no table holds it in clear, and the hash is counted over the whole corpus by distinct
repositories and owners. A value seen by several of them is a copied example; a value that one owner alone
uses, and that looks random, is taken for a live credential and gets a further span of kind ``live``.

Native operators only: matches and the gaps between them come from ``regexp_extract_all`` and ``split``
with one pattern, so offsets are running sums of lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import empty_text, materialize

# The base kinds in their order.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{32,}"
#: Tokens whose shape names their issuer, and private key headers.
SHAPED = (
    r"gh[pousr]_[0-9A-Za-z]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{30,}|[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"
    r"|eyJ[0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
)
KINDS = ("assign", "access", "hex", "live")
LEAST = {0: 8, 1: 16, 2: 32}
#: A value is live-looking with at most so many repositories and owners, at least so many different
#: characters, and none of the words that examples carry.
MOST_REPOSITORIES, MOST_OWNERS, LEAST_DIFFERENT = 1, 2, 6
EXAMPLE_WORDS = r"(?i)example|sample|dummy|placeholder|changeme|change_me|your_|xxxx|12345678|abcdef|test|foobar"


def _found(pattern: str, group: int) -> Column:
    """gap: characters since the last match; m: its length; n, value and looks: length and hash of the value and whether it looks random, of each match in order."""
    p, text = F.lit(pattern), F.col("text")
    every = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gap"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.length(m)).alias("m"),
        F.regexp_extract_all(text, p, F.lit(group)).alias("v"),
    )

    def veiled(x: Column) -> Column:
        random = (F.size(F.array_distinct(F.split(x["v"], ""))) >= LEAST_DIFFERENT) & ~x["v"].rlike(EXAMPLE_WORDS)
        return F.struct(x["gap"].alias("gap"), x["m"].alias("m"), F.length(x["v"]).alias("n"), F.sha2(x["v"], 256).alias("value"), random.alias("looks"))

    return F.when(text.rlike(pattern), F.transform(F.filter(every, lambda x: x["m"].isNotNull()), veiled))


def scan_secrets(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Spans of secrets in every row of ``docs`` (doc_id, text; source and lang unless other columns are named).

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example. A null text has no
    spans; a null repository or owner is one of its own, apart from the empty name; texts of any length are
    scanned whole; rows that repeat are scanned and counted
    each; an empty table gives no rows; other columns are ignored.
    """
    repository = F.col("source") if repository is None else repository
    owner = F.when(F.col("source").isNotNull() | F.col("lang").isNotNull(), F.concat_ws("/", F.col("source"), F.col("lang"))) if owner is None else owner
    rows = docs.select("doc_id", repository.cast("string").alias("repo"), owner.cast("string").alias("owner"), empty_text().alias("text"))
    scanned = rows.select("doc_id", "repo", "owner", _found(ASSIGN, 2).alias("k0"), _found(ACCESS, 0).alias("k1"), _found(HEX, 0).alias("k2"), _found(SHAPED, 0).alias("k3"))
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "secrets-found")

    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k{k}").alias("of")) for k in range(4)])
    hits = scanned.select("row", "repo", "owner", F.explode(kinds).alias("k")).select("row", "repo", "owner", "k.kind", F.posexplode("k.of").alias("i", "x"))
    so_far = Window.partitionBy("row", "kind").orderBy("i")
    start = F.sum("x.gap").over(so_far) + F.coalesce(F.sum("x.m").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = hits.withColumn("start", start.cast("long")).withColumn("end", F.col("start") + F.col("x.m"))
    size = F.when(F.col("kind") == 0, F.col("x.n")).otherwise(F.col("end") - F.col("start"))
    least = F.element_at(F.array(*[F.lit(LEAST.get(k, 0)) for k in range(4)]), F.col("kind") + 1)
    hits = hits.where(size >= least).select("row", "kind", "start", "end", (F.col("end") - F.col("x.n")).alias("from"), "repo", "owner", "x.looks", "x.value")
    hits = materialize(hits, "secrets-hits")

    # Distinct owners of each value; the first grouping shrinks a widely copied value before it meets one task.
    # A null counts as a repository or owner apart from every name, the empty one too.
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")).alias(c)
    used = hits.groupBy("value", named("repo"), named("owner")).agg(F.lit(1).alias("_"))
    owned = used.groupBy("value").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))
    owned = materialize(owned, "secrets-owners")
    judged = hits.join(owned, "value").withColumn("single", (F.col("repos") <= MOST_REPOSITORIES) & (F.col("owners") <= MOST_OWNERS))
    live = F.col("looks") & F.col("single")
    base = F.when(F.col("kind") < 3, F.struct("start", "kind", "end"))
    added = F.when(live, F.struct(F.col("from").alias("start"), F.lit(3).alias("kind"), "end"))
    by_row = judged.groupBy("row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sort_array(F.collect_list(base)).alias("base"), F.collect_set(added).alias("added"), F.count_if(~F.col("single")).alias("n_example"),
    )
    out = scanned.select("row", "doc_id").join(by_row, "row", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    base, added = F.coalesce("base", none), F.coalesce("added", none)
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.sort_array(F.concat(base, added))).alias("spans"),
        F.size(added).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
