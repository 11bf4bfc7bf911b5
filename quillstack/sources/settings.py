"""Settings as JSON over defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The settings that data operators read: the key and direction of listings.
DEFAULTS = {"sortKey": "updated", "sortAsc": False}


def merge_settings(rows: DataFrame, defaults: dict | None = None) -> DataFrame:
    """``rows`` (raw: JSON text) with a column for each setting: the text's value, else the default.

    Null, torn and foreign texts count as having no values.
    """
    defaults = DEFAULTS if defaults is None else defaults
    kinds = {str: "string", bool: "boolean", int: "bigint", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in defaults.items())
    s = rows.withColumn("_s", F.from_json("raw", schema, {"mode": "PERMISSIVE"}))
    return s.select(*rows.columns, *[F.coalesce(f"_s.{k}", F.lit(v)).alias(k) for k, v in defaults.items()])
