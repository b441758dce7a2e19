"""Small builders over DataFrames for what queries need again and again; Catalyst picks the strategies."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point(df: DataFrame, key: str, value) -> DataFrame:
    """The row with a key: the filter reaches the scan, which skips row groups by their bounds."""
    return df.filter(F.col(key) == value)


def join(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "inner", null_safe: bool = False, hint: str | None = None) -> DataFrame:
    """An equi-join on left: right column names; null_safe lets nulls match. Both key columns stay.

    No side is forced to be broadcast: Spark does so by measured size, and splits skewed partitions at run time.
    """
    if hint:
        right = right.hint(hint)
    same = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in on.items()]
    return left.join(right, reduce(and_, same), how)


def semi(left: DataFrame, right: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of left with a match, once each: EXISTS and IN."""
    return join(left, right.select(*on.values()), on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of left without a match: NOT EXISTS, and NOT IN where the right side has no nulls."""
    return join(left, right.select(*on.values()), on, "left_anti")


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of an order: each task keeps k, and only those are merged."""
    return df.orderBy(*order).limit(k)


def like(col: str | Column, pattern: str) -> Column:
    """LIKE without regard to case; % any text, _ one character."""
    return (F.col(col) if isinstance(col, str) else col).ilike(pattern)


def case(col: str | Column, values: Mapping, default=None) -> Column:
    """CASE col WHEN ... THEN ...; null matches none."""
    col = F.col(col) if isinstance(col, str) else col
    out = reduce(lambda c, kv: c.when(col == kv[0], kv[1]), list(values.items())[1:], F.when(col == next(iter(values)), values[next(iter(values))]))
    return out.otherwise(default)


def divide(a: Column, b: Column, whole: bool = False) -> Column:
    """a / b, null for division by zero; whole: cut towards zero, as for integers."""
    if not whole:
        return F.try_divide(a, b)
    return F.call_function("div", a.cast("bigint"), F.nullif(b, F.lit(0)).cast("bigint"))
