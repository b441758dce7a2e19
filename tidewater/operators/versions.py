"""Versions of rows: replaying change logs, what a transaction sees, pruning, and circles of waiting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.workers import checkpoints


def replay(log: DataFrame, keys: Sequence[str], seq: str, op: str, deleted: str = "delete") -> DataFrame:
    """The rows that a log of changes leaves: the last change of each key, unless it deletes.

    The last change is an aggregate, so tasks combine a key's changes before the shuffle, however many it has.
    """
    rest = [c for c in log.columns if c not in (*keys, seq, op)]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(op, *rest), F.col(seq)).alias("_last"))
    return last.filter(F.col(f"_last.{op}") != deleted).select(*keys, *(f"_last.{c}" for c in rest))


def visible(versions: DataFrame, transactions: DataFrame, reader: int, started: int) -> DataFrame:
    """The row versions that a transaction sees: its own writes, and what was committed before it started.

    versions: created_by and deleted_by (null while alive); transactions: tx and committed_at (null until committed).
    A version is gone if the reader deleted it, or one that was committed before the reader started.
    """
    before = transactions.filter(F.col("committed_at") < started).select("tx")
    born = versions.join(before.withColumnRenamed("tx", "_by"), F.col("created_by") == F.col("_by"), "left")
    born = born.filter((F.col("created_by") == reader) | F.col("_by").isNotNull()).drop("_by")
    gone = born.join(before.withColumnRenamed("tx", "_by"), F.col("deleted_by") == F.col("_by"), "left")
    return gone.filter(~(F.coalesce(F.col("deleted_by") == reader, F.lit(False)) | F.col("_by").isNotNull())).drop("_by")


def prune(versions: DataFrame, keys: Sequence[str], oldest_reader: int) -> DataFrame:
    """The versions that anyone can still see: those after the oldest reader's start, and each key's last before it."""
    last = versions.filter(F.col("committed_at") < oldest_reader).groupBy(*keys).agg(F.max("committed_at").alias("_last"))
    kept = versions.join(last, list(keys), "left")
    return kept.filter((F.col("committed_at") >= oldest_reader) | (F.col("committed_at") == F.col("_last"))).drop("_last")


def conflicts(writes: DataFrame) -> DataFrame:
    """(tx, row, first): later writers of a row that another transaction wrote first, while both were open.

    writes: tx, row, started_at, written_at, ended_at.
    """
    a, b = writes.alias("a"), writes.alias("b")
    both = (F.col("a.row") == F.col("b.row")) & (F.col("a.tx") != F.col("b.tx")) & (F.col("b.written_at") < F.col("a.written_at")) & (F.col("a.started_at") < F.col("b.ended_at"))
    return a.join(b, both).groupBy(F.col("a.tx").alias("tx"), F.col("a.row").alias("row")).agg(F.min_by("b.tx", "b.written_at").alias("first"))


def deadlocked(waits: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(tx): transactions on a circle of waiting, or that wait and are waited for by such; waits: waiter, holder.

    Those that wait for nobody, or that nobody waits for, are taken away again and again; what is left is circles,
    and chains between circles. RuntimeError if that has not settled after max_rounds, as chains may be longer.
    """
    checkpoints(waits.sparkSession)
    now = waits.select("waiter", "holder").filter("waiter <> holder").distinct()
    n = now.count()
    for _ in range(max_rounds):
        held, waiting = now.select(F.col("holder").alias("_t")).distinct(), now.select(F.col("waiter").alias("_t")).distinct()
        now = now.join(held, F.col("waiter") == F.col("_t"), "left_semi").join(waiting, F.col("holder") == F.col("_t"), "left_semi").checkpoint()
        if (m := now.count()) == n:
            return now.select(F.col("waiter").alias("tx")).distinct()
        n = m
    raise RuntimeError(f"chains of waiting did not settle in {max_rounds} rounds")
