"""Choices between values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

coalesce, nullif = F.coalesce, F.nullif


def truthy(x: Column, kind: str = "boolean") -> Column:
    """True for numbers other than 0, texts other than '', and true; null counts as false."""
    true = {"boolean": x, "string": x != ""}.get(kind, x != 0)
    return F.coalesce(true, F.lit(False))


def if_(condition: Column, then: Column, otherwise: Column, kind: str = "boolean") -> Column:
    return F.when(truthy(condition, kind), then).otherwise(otherwise)


def ifnull(x: Column, otherwise: Column) -> Column:
    return F.coalesce(x, otherwise)
