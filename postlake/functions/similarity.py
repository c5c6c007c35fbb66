"""Token-set similarity: an Indel ratio over shared and differing words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence length; one machine-word style pass with Python's big integers."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for ch in a:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(IntegerType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int32")


def word_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")))


def ratio_parts(a: Column, b: Column) -> dict[str, Column]:
    """Pieces of the ratio for two sorted word sets: lengths of the shared part and the two rests."""
    both = F.array_intersect(a, b)
    xa, xb = F.array_except(a, b), F.array_except(b, a)
    return {
        "s": F.length(F.array_join(both, " ")),
        "x": F.array_join(xa, " "),
        "y": F.array_join(xb, " "),
    }


def subset_ratio(s: Column, rest: Column) -> Column:
    """Ratio of the shared words against shared words plus one rest."""
    n = F.length(rest)
    g = (s > 0).cast("int")
    return F.lit(100.0) * (F.lit(1.0) - (g + n) / F.nullif(s + s + g + n, F.lit(0)).cast("double"))


def rest_ratio(s: Column, x: Column, y: Column, common: Column) -> Column:
    """Ratio of both full strings given the common subsequence length of the rests."""
    lx, ly = F.length(x), F.length(y)
    g = (s > 0).cast("int")
    total = s + g + lx + s + g + ly
    return F.lit(100.0) * (F.lit(1.0) - (lx + ly - 2 * common) / F.nullif(total, F.lit(0)).cast("double"))


def token_set_ratio_py(a: str, b: str) -> float:
    """Reference model for tests."""
    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    both = wa & wb
    x, y = " ".join(sorted(wa - wb)), " ".join(sorted(wb - wa))
    if both and (not x or not y):
        return 100.0
    s = len(" ".join(sorted(both)))
    g = 1 if s else 0
    la, lb = s + g + len(x), s + g + len(y)
    r1 = 100.0 * (1 - (len(x) + len(y) - 2 * _lcs(x, y)) / (la + lb))
    if not s:
        return r1
    r2 = 100.0 * (1 - (g + len(x)) / (s + la))
    r3 = 100.0 * (1 - (g + len(y)) / (s + lb))
    return max(r1, r2, r3)
