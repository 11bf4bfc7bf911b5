"""Spark types from short names, without a session (modules are imported by Python workers too)."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def kind(x) -> T.DataType:
    return _SIMPLE[x] if isinstance(x, str) else x


def array(of) -> T.ArrayType:
    return T.ArrayType(kind(of))


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, kind(v)) for k, v in fields.items()])
