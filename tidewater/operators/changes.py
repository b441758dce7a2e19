"""Changes to tables as functions from the rows before to the rows after, and the checks that guard them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """The table with rows added; columns that they lack get a default, or null."""
    missing = {f.name: (defaults or {}).get(f.name, F.lit(None)).cast(f.dataType) for f in table.schema if f.name not in rows.columns}
    return table.unionByName(rows.withColumns(missing).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema)))


def number(table: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """rows whose null keys go on from the table's largest: SERIAL columns.

    Rows are numbered within blocks of a range of the order, and blocks by their sizes, so no task gets all rows.
    """
    start = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_start"))  # one row
    given, open_ = rows.filter(F.col(key).isNotNull()), rows.filter(F.col(key).isNull())
    blocks = open_.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    blocks = blocks.select("*", F.shiftright("_at", 33).alias("_block"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    sizes = blocks.groupBy("_block").agg((F.max("_row") + 1).alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    done = blocks.join(F.broadcast(before), "_block").join(F.broadcast(start), F.lit(True)).withColumn(key, (F.col("_start") + F.col("_before") + F.col("_row") + 1).cast(table.schema[key].dataType))
    return given.unionByName(done.select(*rows.columns))


def update(table: DataFrame, assignments: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """Assigned columns where the condition holds; all of them see the row as it was."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return table.select(*(F.when(hit, assignments[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in assignments else F.col(f.name) for f in table.schema))


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """The rows for which the condition is false or null."""
    return table.limit(0) if where is None else table.filter(~F.coalesce(where, F.lit(False)))


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], assignments: Mapping[str, Column] | None = None) -> DataFrame:
    """INSERT ... ON DUPLICATE KEY UPDATE: rows whose keys are there change them, others are added.

    Assignments see old columns by name and the new row's as new.<column>; by default all other columns are taken.
    One full join on the keys.
    """
    old, new = table.alias("old"), rows.alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    both = old.withColumn("_old", F.lit(True)).alias("old").join(new.withColumn("_new", F.lit(True)).alias("new"), on, "full")
    hit, added = F.col("_old").isNotNull() & F.col("_new").isNotNull(), F.col("_old").isNull()
    assignments = assignments or {c: F.col(f"new.{c}") for c in rows.columns if c not in keys}

    def value(f) -> Column:
        own, fresh = F.col(f"old.{f.name}"), F.col(f"new.{f.name}") if f.name in rows.columns else F.lit(None)
        changed = assignments[f.name] if f.name in assignments else own
        return F.when(added, fresh).when(hit, changed).otherwise(own).cast(f.dataType).alias(f.name)

    return both.select(*(value(f) for f in table.schema))


def violations_not_null(table: DataFrame, cols: Sequence[str]) -> DataFrame:
    return table.filter(reduce(or_, (F.col(c).isNull() for c in cols)))


def violations_check(table: DataFrame, check: Column) -> DataFrame:
    """Rows for which a check is false; null passes."""
    return table.filter(~F.coalesce(check, F.lit(True)))


def violations_unique(table: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """(keys, n): keys that several rows have, where a partial index's condition holds; keys with a null are free."""
    rows = table if where is None else table.filter(where)
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def violations_foreign_key(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of child whose reference, if not null, no parent has."""
    refer = child.dropna(subset=list(on))
    return refer.join(parent.select(*on.values()).distinct(), [child[a] == parent[b] for a, b in on.items()], "left_anti")


def delete_parents(parent: DataFrame, child: DataFrame, on: Mapping[str, str], where: Column, action: str) -> tuple[DataFrame, DataFrame]:
    """Both tables after parents are deleted. action: restrict (raises if one is referred to), cascade or set null."""
    gone, left = parent.filter(where), delete(parent, where)
    same = [child[a] == gone[b] for a, b in on.items()]
    if action == "cascade":
        return left, child.join(gone, same, "left_anti")
    if action == "set null":
        marked = child.join(gone.select(*on.values()).withColumn("_gone", F.lit(True)).distinct(), same, "left")
        return left, marked.select(*(F.when(F.col("_gone").isNull(), child[c]).cast(child.schema[c].dataType).alias(c) if c in on else child[c] for c in child.columns))
    if action in ("restrict", "no action"):
        if not child.join(gone, same, "left_semi").isEmpty():
            raise ValueError("rows refer to what is to be deleted")
        return left, child
    raise ValueError(f"unknown action {action}")


def update_parents(parent: DataFrame, child: DataFrame, key: str, ref: str, value: Column, where: Column, action: str) -> tuple[DataFrame, DataFrame]:
    """Both tables after parents' keys change; the references follow, become null, or forbid it."""
    moved = parent.filter(where).select(F.col(key).alias("_from"), value.alias("_to")).filter("not _from <=> _to")
    after = update(parent, {key: value}, where)
    if action in ("restrict", "no action"):
        if not child.join(moved, child[ref] == F.col("_from"), "left_semi").isEmpty():
            raise ValueError("rows refer to what is to be changed")
        return after, child
    if action not in ("cascade", "set null"):
        raise ValueError(f"unknown action {action}")
    new = F.col("_to") if action == "cascade" else F.lit(None)
    both = child.join(moved, child[ref] == F.col("_from"), "left")
    return after, both.select(*(F.when(F.col("_from").isNull(), child[c]).otherwise(new).cast(child.schema[c].dataType).alias(c) if c == ref else child[c] for c in child.columns))


def add_column(table: DataFrame, name: str, kind: str, default: Column | None = None) -> DataFrame:
    return table.withColumn(name, (F.lit(None) if default is None else default).cast(kind))
