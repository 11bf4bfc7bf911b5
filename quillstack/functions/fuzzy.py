"""Bounded edit distance with adjacent transpositions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quillstack.types import kind


def osa_distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (insert, delete, replace, swap neighbours once), ``most`` + 1 beyond ``most``."""
    la, lb = len(a), len(b)
    if a == b:
        return 0
    if abs(la - lb) > most:
        return most + 1
    rows = [list(range(lb + 1))]
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * lb
        for j in range(max(1, i - most), min(lb, i + most) + 1):
            y = b[j - 1]
            best = min(row[j - 1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row[j] = best
        if min(row) > most:
            return most + 1
        rows.append(row)
    return min(rows[-1][lb], most + 1)


@F.pandas_udf(kind("int"))
def osa_udf(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([osa_distance(x, y, m) for x, y, m in zip(a, b, most, strict=True)], index=a.index, dtype="int32")
