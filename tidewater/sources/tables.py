"""Reading the tables, and the types that columns may be declared with."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of a data directory.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a lazy scan: only the columns and row groups that a query needs are read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> None:
    """Makes the tables known to spark.sql as temporary views."""
    for name in names:
        read(spark, sf_dir, name).createOrReplaceTempView(name)


#: The smallest and largest number that each whole-number type holds.
RANGES = {"smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1), "serial": (-(2**31), 2**31 - 1), "bigserial": (-(2**63), 2**63 - 1)}
_SPARK = {"smallint": "smallint", "int": "int", "bigint": "bigint", "serial": "int", "bigserial": "bigint"}


def coerce(value: Column, declared: str) -> Column:
    """A value as a strictly typed column takes it; null where it does not fit.

    Whole numbers are cut towards zero and must be in range; varchar(n) must not be longer; char(n) is cut or padded;
    decimal(p,s) must fit without rounding; uuid must be one, and is lower case with hyphens.
    """
    kind, _, rest = declared.lower().replace(" ", "").partition("(")
    sizes = [int(x) for x in rest.rstrip(")").split(",")] if rest else []
    if kind in RANGES:
        return _whole(value, kind)
    if kind in ("varchar", "text"):
        text = value.cast("string")
        return F.when(F.length(text) <= sizes[0], text) if sizes else text
    if kind == "char":
        n = sizes[0] if sizes else 1
        return F.rpad(F.substring(value.cast("string"), 1, n), n, " ")
    if kind in ("decimal", "numeric"):
        precision, scale = (*sizes, 0)[:2]
        exact = value.cast("string").try_cast("decimal(38,18)")
        fits = exact.try_cast(f"decimal({precision},{scale})")
        return F.when(fits == exact, fits)
    if kind in ("uuid", "guid"):
        digits = F.lower(F.regexp_replace(value.cast("string"), "[{}-]", ""))
        return F.when(digits.rlike("^[0-9a-f]{32}$"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    if kind in ("float", "real"):
        return value.cast("string").try_cast("double")
    raise ValueError(f"unknown type {declared}")


def _whole(value: Column, kind: str) -> Column:
    low, high = RANGES[kind]
    number = value.cast("string").try_cast("double")
    cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.when((number >= low) & (number <= high), cut.try_cast(_SPARK[kind]))
