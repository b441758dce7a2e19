"""Statistics of tables and what they say about conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_statistics(df: DataFrame) -> DataFrame:
    """(column, n, nulls, distinct, width, low, high) of each column, low and high as text: all in one pass."""
    aggs = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        width = F.avg(F.length(c.cast("string")))
        aggs.append(F.struct(F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"), F.approx_count_distinct(c, 0.01).alias("distinct"), width.alias("width"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")).alias(f.name))
    return df.agg(*aggs).select(F.inline(F.array(*(F.col(f"`{f.name}`") for f in df.schema))))


def exact_statistics(df: DataFrame, *cols: str) -> DataFrame:
    """As column_statistics, with exact counts of different values."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"), F.countDistinct(c).alias("distinct")).alias(c) for c in cols]
    return df.agg(*parts).select(F.inline(F.array(*cols)))


def histogram(df: DataFrame, col: str, buckets: int) -> DataFrame:
    """(bucket, low, high, n): buckets of about equal numbers of rows; equal values share one.

    The bounds are quantiles, so the rows are not sorted or gathered.
    """
    v = F.col(col).cast("double")
    cuts = df.filter(v.isNotNull()).agg(F.percentile_approx(v, [k / buckets for k in range(1, buckets)], 100_000).alias("_cuts"))  # one row
    placed = df.filter(v.isNotNull()).join(F.broadcast(cuts), F.lit(True)).select(v.alias("v"), (F.size(F.filter("_cuts", lambda c: c < F.col("v"))) + 1).alias("bucket"))
    return placed.groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows at random, all equally likely: each task keeps n."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")


def equality_selectivity(distinct: Column) -> Column:
    """The share of rows that equal a value, if all values are equally frequent."""
    return F.when(distinct > 0, 1 / distinct).otherwise(F.lit(1.0))


def null_fraction(nulls: Column, n: Column) -> Column:
    return F.when(n > 0, nulls / n).otherwise(F.lit(0.0))
