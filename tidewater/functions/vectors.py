"""Vector functions over arrays of floats, added up in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names that metrics go by.
METRICS = {"cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean", "manhattan": "manhattan", "l1": "manhattan"}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _pairs(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalize(v: Column) -> Column:
    """At length 1; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: (x.cast("double") / size).cast("float"))).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), _pairs(a, b, lambda x, y: x * y)).when(a.isNotNull() & b.isNotNull(), 0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot, for vectors at length 1; 2 for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), 1 - dot(a, b)).when(a.isNotNull() & b.isNotNull(), 2.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y)))).when(a.isNotNull() & b.isNotNull(), float("inf"))


def manhattan(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _pairs(a, b, lambda x, y: F.abs(x - y))).when(a.isNotNull() & b.isNotNull(), float("inf"))


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"cosine": cosine_distance, "euclidean": euclidean, "manhattan": manhattan}[METRICS[metric.lower()]](a, b)


def to_bytes(v: Column) -> Column:
    """As stored: the length and the floats, little-endian."""

    @F.pandas_udf("binary")
    def pack(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else len(x).to_bytes(4, "little") + np.asarray(x, "<f4").tobytes() for x in column], dtype="object")

    return pack(v)


def from_bytes(b: Column) -> Column:
    """Back from bytes; null if they are no vector."""

    @F.pandas_udf("array<float>")
    def unpack(column: pd.Series) -> pd.Series:
        def one(x):
            if x is None or len(x) < 4 or int.from_bytes(x[:4], "little") * 4 + 4 != len(x):
                return None
            return np.frombuffer(x, "<f4", offset=4)

        return pd.Series([one(x) for x in column], dtype="object")

    return unpack(b)
