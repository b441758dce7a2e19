"""Every query against its SQL on DuckDB, over the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from tidewater.plans import registry
from tidewater.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        connection.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted(repr([plain(v) for v in row]) for row in df.select([f"`{c}`" for c in cols]).collect())
    result = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(result.columns) == cols
    theirs = duck.sql("select {} from ({})".format(", ".join(f'"{c}"' for c in cols), registry.ORACLE_SQL[name])).fetchall()
    assert ours == sorted(repr([plain(v) for v in row]) for row in theirs)


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLE_SQL.keys()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
