"""Note files, version logs and the store on shared folders."""

from __future__ import annotations

import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.operators.history import expired, recover
from quillstack.operators.links import extract_link_keys, extract_tags
from quillstack.schema import VERSION

RULE = "---"
KEYS = ("id", "title", "created", "updated", "rev", "pinned", "archived", "locked", "trashed")


def serialize(strict_roundtrip: bool = False) -> Column:
    """The file of a note row: header lines between rules, then the body as it is.

    ``strict_roundtrip`` guards a body that begins with a newline, which reading would drop otherwise.
    """
    title = tx.trim(F.regexp_replace("title", r"\r?\n", " "))
    values = {"id": F.col("note_id"), "title": title, "created": F.col("created_at"), "updated": F.col("updated_at"), "rev": F.col("rev"), "pinned": F.col("pinned"), "archived": F.col("archived"), "locked": F.col("locked"), "trashed": F.coalesce(F.col("trashed_at").cast("string"), F.lit(""))}
    lines = [F.concat(F.lit(f"{k}: "), values[k].cast("string")) for k in KEYS]
    body = F.when(F.col("body").startswith("\n"), F.concat(F.lit("\n"), "body")).otherwise(F.col("body")) if strict_roundtrip else F.col("body")
    return F.concat_ws("\n", F.lit(RULE), *lines, F.lit(RULE), body)


def _number(c: Column, fallback: Column) -> Column:
    v = F.when(tx.trim(c) == "", F.lit(0.0)).otherwise(c.try_cast("double"))
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), fallback).otherwise(v.cast("bigint"))


def parse_notes(files: DataFrame, now: int = 0) -> DataFrame:
    """Notes from rows (file_id, raw). A file without a complete header is all body; bad fields take their defaults."""
    opened = F.col("raw").startswith(RULE)
    end = F.when(opened, F.locate(f"\n{RULE}", F.col("raw"), len(RULE) + 1)).otherwise(0)
    rows = files.withColumn("_end", end)
    head = F.when(F.col("_end") > 0, F.expr(f"substring(raw, {len(RULE) + 2}, greatest(0, _end - {len(RULE) + 2}))"))
    body = F.when(F.col("_end") > 0, F.regexp_replace(F.expr(f"substring(raw, _end + {len(RULE) + 2})"), r"\A\n", "")).otherwise(F.col("raw"))
    entry = F.transform(F.split(head, "\n"), lambda x: F.struct(tx.trim(F.regexp_extract(x, r"(?s)\A([^:]+):(.*)\z", 1)).alias("k"), tx.trim(F.regexp_extract(x, r"(?s)\A([^:]+):(.*)\z", 2)).alias("v")))
    rows = rows.select("file_id", entry.alias("h"), body.alias("body"), (F.col("_end") > 0).alias("has"))

    def value(k: str) -> Column:  # the last line with the key
        return F.try_element_at(F.filter("h", lambda x: x["k"] == k), F.lit(-1))["v"]

    base = F.lit(now).cast("bigint")
    created = F.when(value("created").isNull(), base).otherwise(_number(value("created"), base))
    rows = rows.withColumn("created_at", created)
    updated = F.when(value("updated").isNull(), F.col("created_at")).otherwise(_number(value("updated"), F.col("created_at")))
    gone = F.when(F.coalesce(value("trashed"), F.lit("")) == "", None).otherwise(F.nullif(_number(value("trashed"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint")))
    flag = {k: F.coalesce(value(k) == "true", F.lit(False)).alias(k) for k in ("pinned", "archived", "locked")}
    one = F.lit(1).cast("bigint")
    return rows.select(
        F.coalesce(F.nullif(value("id"), F.lit("")), F.col("file_id")).alias("note_id"), F.coalesce(value("title"), F.lit("")).alias("title"), "body", "created_at", updated.alias("updated_at"),
        extract_tags(F.col("body")).alias("tags"), extract_link_keys(F.col("body")).alias("links"), flag["pinned"], flag["archived"], flag["locked"], gone.alias("trashed_at"),
        F.when(value("rev").isNull(), one).otherwise(_number(value("rev"), one)).cast("int").alias("rev"),
    )


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, raw of the .md files in a folder; whole files, in parallel. Empty files, which Spark's readers
    pass over, come from the folder's listing with raw null."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    rows = rows.select(F.regexp_replace("_metadata.file_name", r"\.md\z", "").alias("file_id"), F.col("value").alias("raw"))
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [(f.getPath().getName(), f.getLen()) for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    blank = [(n.removesuffix(".md"), None) for n, size in names if n.endswith(".md") and not size]
    return rows.unionByName(spark.createDataFrame(blank, rows.schema))


def decode_versions(lines: DataFrame) -> DataFrame:
    """Versions from rows (note_id, line, ord) of JSON; torn lines and those whose rev is no number or whose body is no string are dropped."""
    field = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    is_text = lambda name: F.coalesce(F.schema_of_variant(field(name)) == "STRING", F.lit(False))
    is_number = lambda name: F.coalesce(F.schema_of_variant(field(name)).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    rows = lines.withColumn("v", F.try_parse_json("line")).where(is_number("rev") & is_text("body"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    return rows.select(
        "note_id", get("rev", "double").cast("int").alias("rev"), F.when(is_number("at"), get("at", "double")).cast("bigint").alias("at"),
        F.when(is_text("title"), get("title", "string")).otherwise("").alias("title"), get("body", "string").alias("body"), "ord",
    )


def encode_versions(versions: DataFrame) -> DataFrame:
    """note_id, line: a JSON object for each version."""
    return versions.select("note_id", F.to_json(F.struct("rev", "at", "title", "body")).alias("line"))


def read_version_log(spark: SparkSession, folder: str) -> DataFrame:
    """Versions from <note_id>.jsonl files."""
    rows = spark.read.option("pathGlobFilter", "*.jsonl").text(folder, wholetext=True)
    named = rows.select(F.regexp_replace("_metadata.file_name", r"\.jsonl\z", "").alias("note_id"), F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    return decode_versions(named.where(tx.trim(F.col("line")) != ""))


def load(files: DataFrame, versions: DataFrame, now: int) -> DataFrame:
    """Notes with a status: ok, recovered (from the newest version), unreadable or purged (too long in the trash); latest update first.

    Blank and unreadable files (raw null) are the ones recovered; a note without a file isn't.
    """
    blank = F.coalesce(tx.trim(F.col("raw")) == "", F.lit(True))
    good = parse_notes(files.where(~blank), now)
    good = good.withColumn("status", F.when(expired(now), "purged").otherwise("ok"))
    lost = files.where(blank).select(F.col("file_id").alias("note_id"))
    back = recover(versions.join(lost, "note_id", "left_semi"))
    out = good.unionByName(back.withColumn("status", F.lit("recovered")))
    dead = lost.join(back.select("note_id"), "note_id", "left_anti")
    every = out.unionByName(dead.withColumn("status", F.lit("unreadable")), allowMissingColumns=True)
    return every.orderBy(F.desc_nulls_last("updated_at"), "note_id")


def write_files(notes: DataFrame, folder: str) -> int:
    """A file <note_id>.md for each note, as ``read_files`` reads them; how many were written.

    Tasks write to a name of their own and rename, so that a reader or a crash meets whole files only, and a
    task that runs again writes the same ones. ``folder`` is a path or URI that pyarrow's file systems know.
    For a large collection prefer ``save``: a file for each note costs a store more than its bytes.
    """

    def work(batches):
        store, root = pa_fs.FileSystem.from_uri(folder) if "://" in folder else (pa_fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for note_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"{root}/{quote(note_id, safe=' ')}.md"
                part = f"{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(text.encode())
                store.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], type=pa.int64())], names=["n"])

    made = notes.select("note_id", serialize().alias("value")).mapInArrow(work, "n long")
    return made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def append_versions(versions: DataFrame, path: str) -> None:
    """Appends to the version table; existing rows are never rewritten."""
    versions.select([f.name for f in VERSION.fields]).write.mode("append").parquet(path)


def _snapshots(spark: SparkSession, table: str) -> tuple[list[int], object, object]:
    """Numbers of the complete snapshots in order, the store and the class of its paths."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    store = path_of(table).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(path_of(table))] if store.exists(path_of(table)) else []
    done = [n for n in names if n.startswith("snapshot=") and store.exists(path_of(f"{table}/{n}/_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in done), store, path_of


def saved(spark: SparkSession, table: str) -> DataFrame | None:
    """The notes of the last complete save, None before the first."""
    numbers, _, _ = _snapshots(spark, table)
    return spark.read.parquet(f"{table}/snapshot={numbers[-1]:012d}") if numbers else None


def save(notes: DataFrame, table: str, log: str) -> None:
    """The log first, then a snapshot in a folder of its own, which counts once Spark has committed it.

    So a crash at any point leaves the last save whole, and notes read from ``saved`` may be saved again. The
    save before the last stays for those who still read it; older ones go.
    """
    spark = notes.sparkSession
    append_versions(notes.select("note_id", "rev", F.col("updated_at").alias("at"), "title", "body"), log)
    numbers, store, path_of = _snapshots(spark, table)
    notes.write.mode("overwrite").parquet(f"{table}/snapshot={(numbers[-1] + 1 if numbers else 0):012d}")
    for old in numbers[:-1]:
        store.delete(path_of(f"{table}/snapshot={old:012d}"), True)


def check_listing(rows: DataFrame, limits: dict[str, int], no_price: tuple[str, ...] = ()) -> DataFrame:
    """column, length, too_long, price, spaced for a one-row table of listing texts."""
    price = r"(?i)\bfree\b|\bprice[ds]?\b|\bsale\b|\bdiscount\b|\bsubscription\b|\$"
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text"), F.lit(n).alias("most"), F.lit(c in no_price).alias("guard")) for c, n in limits.items()])
    x = rows.select(F.explode(cells).alias("x")).select("x.*")
    return x.select("column", F.length("text").alias("length"), (F.length("text") > F.col("most")).alias("too_long"), (F.col("guard") & F.col("text").rlike(price)).alias("price"), ((F.upper("column") == "KEYWORDS") & F.col("text").rlike(r",\s")).alias("spaced"))
