"""Aggregates that users define: state, update, merge and result, run as partial and final steps."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.workers import python_ready


class Aggregate(Protocol):
    """Init, step and finalize over numbers; merge joins the states of two tasks."""

    def init(self) -> float: ...

    def step(self, state: float, values: pd.Series) -> float: ...

    def merge(self, states: pd.Series) -> float: ...

    def finalize(self, state: float) -> float: ...


class SumOfSquares:
    """An example: the sum of squares; null for no values."""

    def init(self) -> float:
        return 0.0

    def step(self, state: float, values: pd.Series) -> float:
        return state + float((values.astype(float) ** 2).sum())

    def merge(self, states: pd.Series) -> float:
        return float(states.sum())

    def finalize(self, state: float) -> float:
        return state


def udaf(df: DataFrame, keys: Sequence[str], value: str, function: Aggregate, alias: str) -> DataFrame:
    """keys and the aggregate of the non-null values. Each task steps through its rows first and hands on one state a key and batch."""
    keys = list(keys)
    python_ready(df.sparkSession)

    def partial(batches):
        for pdf in batches:
            done = pdf.dropna(subset=[value]).groupby(keys, dropna=False)[value].apply(lambda v: function.step(function.init(), v))
            yield done.rename("_state").reset_index()[[*keys, "_state"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    states = df.select(*keys, value).withColumn(value, F.col(value).cast("double")) if value not in keys else df.select(*keys)
    states = states.mapInPandas(partial, f"{schema}, _state double")

    def final(pdf):
        out = pdf[keys].head(1).copy()
        out[alias] = function.finalize(function.merge(pdf["_state"]))
        return out

    return states.groupBy(*keys).applyInPandas(final, f"{schema}, `{alias}` double")
