"""Nearest neighbours: exact by a distributed top k, or by random hyperplanes where tables are very large."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import vectors as V

#: Fixed value: vectors whose dot products are added up at a time, few enough to stay in a core's cache.
BLOCK = 256


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)).cast("float") for x in v))


def quantize(df: DataFrame, col: str, dim: int | None = None, normalize: bool = True) -> DataFrame:
    """The table with its vectors checked and at length 1, as a search expects them; rows of another dimension go."""
    out = df.filter(F.col(col).isNotNull())
    out = out.filter(F.size(col) == dim) if dim else out
    return out.withColumn(col, V.normalize(F.col(col))) if normalize else out


def knn(df: DataFrame, id_col: str, col: str, query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
    """(rowid, distance) of the k nearest, ties by id. Each task keeps k rows; only those are merged."""
    if k <= 0:
        raise ValueError("k must be positive")
    found = df.select(F.col(id_col).alias("rowid"), V.distance(metric, F.col(col), literal(query)).alias("distance"))
    return found.orderBy("distance", "rowid").limit(k)


def _keys(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """A row of keys for each vector. Products are added up in order, so a vector has its keys in any batch."""
    rng = random.Random(seed)
    planes = np.array([[rng.gauss(0, 1) for _ in range(vectors.shape[1])] for _ in range(tables * bits)], "f4").astype("f8")
    out = np.empty((len(vectors), tables), "i8")
    for at in range(0, len(vectors), BLOCK):
        block = vectors[at : at + BLOCK].astype("f8")
        dots = np.zeros((len(block), len(planes)))
        for x, p in zip(block.T, planes.T, strict=True):
            dots += x[:, None] * p
        out[at : at + BLOCK] = (dots > 0).reshape(-1, tables, bits) @ (1 << np.arange(bits)) + np.arange(tables) * (1 << bits)
    return out


def hyperplane_keys(col: Column, dim: int, tables: int = 8, bits: int = 6, seed: int = 7) -> Column:
    """For each of some hash tables, which sides of random planes a vector lies on; null for vectors with nulls.

    In Arrow batches: as expressions, the dot products with all planes took most of an index's time.
    """

    @F.arrow_udf("array<bigint>")
    def keys(column: pa.Array) -> pa.Array:
        whole = column.is_valid().to_numpy(zero_copy_only=False)
        fits = pc.equal(pc.fill_null(pc.list_value_length(column), -1), dim).to_numpy(zero_copy_only=False)
        values = column.filter(pa.array(fits)).flatten()
        vectors = np.zeros((len(column), dim), "f4")  # those of another dimension lie on no plane's upper side
        vectors[fits] = values.to_numpy(zero_copy_only=False).reshape(-1, dim)
        whole[fits] &= values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim).all(axis=1)
        flat = _keys(vectors[whole], tables, bits, seed).reshape(-1)
        ends = np.concatenate(([0], np.cumsum(whole) * tables))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()), mask=pa.array(~whole))

    return keys(col.cast("array<float>"))


def hyperplane_index(df: DataFrame, id_col: str, col: str, dim: int, **options) -> DataFrame:
    """(rowid, vector, key), a row for each hash table: what approximate search probes; write it bucketed by key."""
    return df.select(F.col(id_col).alias("rowid"), F.col(col).alias("vector"), F.explode(hyperplane_keys(F.col(col), dim, **options)).alias("key"))


def approximate_knn(index: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", tables: int = 8, bits: int = 6, seed: int = 7) -> DataFrame:
    """(rowid, distance) of the k nearest among rows that share a bucket with the query: a part of the table is read.

    A row that shares several buckets is merged by its distance, so vectors are not shuffled.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    keys = _keys(np.array([query], "f4"), tables, bits, seed)[0].tolist()
    near = index.filter(F.col("key").isin(keys)).select("rowid", V.distance(metric, F.col("vector"), literal(query)).alias("distance"))
    return near.groupBy("rowid").agg(F.min("distance").alias("distance")).orderBy("distance", "rowid").limit(k)
