"""Window specifications with explicit ROWS frames."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F


def spec(partition=(), order=()) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order)


def rows(partition=(), order=(), start: int | None = None, end: int | None = 0) -> WindowSpec:
    """Rows from start to end around the current one; None is unbounded. Default: up to the current row, ties or not."""
    low = Window.unboundedPreceding if start is None else start
    high = Window.unboundedFollowing if end is None else end
    return spec(partition, order).rowsBetween(low, high)


def running(agg, partition=(), order=()):
    """An aggregate up to the current row when ordered, else over the whole partition."""
    return agg.over(rows(partition, order) if order else Window.partitionBy(*partition))


def row_number(partition, order):
    return F.row_number().over(spec(partition, order))
