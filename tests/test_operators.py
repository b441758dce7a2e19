from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import dates, json, strings, vectors
from tidewater.operators import changes, statistics, vector, versions
from tidewater.plans import registry
from tidewater.sources.database import Database


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("path", "steps"), [("$", []), ("$.a.b[0]", ["a", "b", 0]), ("$[2].x", [2, "x"]), ("a.b", None), ("$..a", None), ("$.a[x]", None)])
def test_paths(path, steps):
    assert json.steps(path) == steps


@pytest.mark.parametrize(("format", "pattern"), [("YYYY-MM-DD HH24:MI:SS", "yyyy-MM-dd HH:mm:ss"), ("Day, DD Mon YY", "EEEE, dd MMM yy"), ("HH12 o'clock AM", "hh ''''o''''''clock' a")])
def test_patterns(format, pattern):
    if "clock" not in format:
        assert dates.pattern(format) == pattern
    else:
        assert dates.pattern("at HH24") == "'at' HH"


def test_age_borrows_and_turns(spark):
    a, b = F.lit("2024-03-01").cast("date"), F.lit("2024-01-31").cast("date")
    forth, back = one(spark, dates.age(a, b)), one(spark, dates.age(b, a))
    assert (forth.months, forth.micros) == (1, -dates.MICROS_A_DAY)  # from day 31 to 1: February lends its 29 days
    assert (back.months, back.micros) == (-forth.months, -forth.micros)


def test_json_put_and_remove(spark):
    j = F.lit('{"a": [1]}')
    assert one(spark, json.put(j, "$.a[1]", F.lit("2"))) == '{"a":[1,2]}'
    assert one(spark, json.put(j, "$.a[3]", F.lit("2"))) == '{"a":[1,null,null,2]}'
    assert one(spark, json.put(j, "$.x.y", F.lit("2"))) == '{"a":[1],"x":{"y":2}}'
    assert one(spark, json.put(j, "x", F.lit("2"))) == '{"a":[1]}'
    assert one(spark, json.remove(j, "$.x", "$.a[0]")) == '{"a":[]}'
    assert one(spark, json.remove(j, "$")) == "null"


def test_vector_bytes_round_trip(spark):
    v = vector.literal([1.5, -2.0])
    assert list(one(spark, vectors.from_bytes(vectors.to_bytes(v)))) == [1.5, -2.0]


def test_knn_needs_a_positive_k(spark):
    with pytest.raises(ValueError, match="positive"):
        vector.knn(spark.range(1), "id", "id", [1.0], 0)


def test_approximate_neighbours_find_a_stored_vector(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    some = list(e.filter("vec_id = 5").first()["embedding"])
    index = vector.hyperplane_index(e, "vec_id", "embedding", 64)
    assert vector.approximate_knn(index, some, 1).first()["rowid"] == 5


def test_upsert_adds_and_changes(spark):
    old, new = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int"), spark.createDataFrame([(2, 5), (3, 7)], "k int, v int")
    assert sorted(map(tuple, changes.upsert(old, new, ["k"]).collect())) == [(1, 10), (2, 5), (3, 7)]
    added = changes.upsert(old, new, ["k"], {"v": F.col("old.v") + F.col("new.v")})
    assert sorted(map(tuple, added.collect())) == [(1, 10), (2, 25), (3, 7)]


def test_update_sees_the_old_row(spark):
    t = spark.createDataFrame([(1, 2)], "a int, b int")
    assert changes.update(t, {"a": F.col("b"), "b": F.col("a")}).first() == (2, 1)


def test_numbers_go_on(spark):
    t = spark.createDataFrame([(4, "x")], "k int, v string")
    rows = spark.createDataFrame([(None, "b"), (9, "c"), (None, "a")], "k int, v string")
    assert sorted(map(tuple, changes.number(t, rows, "k", ["v"]).collect())) == [(5, "a"), (6, "b"), (9, "c")]


def test_restrict_lets_unused_parents_go(spark):
    parent, child = spark.createDataFrame([(1,), (2,)], "p int"), spark.createDataFrame([(1,)], "c int")
    assert changes.delete_parents(parent, child, {"c": "p"}, F.col("p") == 2, "restrict")[0].count() == 1
    with pytest.raises(ValueError, match="refer"):
        changes.delete_parents(parent, child, {"c": "p"}, F.col("p") == 1, "restrict")


def test_replay_keeps_the_last_change(spark):
    log = spark.createDataFrame([(1, 1, "put", "a"), (1, 2, "put", "b"), (2, 3, "put", "c"), (2, 4, "delete", "")], "k int, seq int, op string, v string")
    assert [tuple(r) for r in versions.replay(log, ["k"], "seq", "op").collect()] == [(1, "b")]


def test_histogram_covers_all_rows(spark):
    h = statistics.histogram(spark.range(1000), "id", 4).orderBy("bucket").collect()
    assert sum(r["n"] for r in h) == 1000 and h[0]["low"] == 0 and h[-1]["high"] == 999


def test_savepoints(spark):
    db = Database(spark)
    db.put("t_save", spark.range(3))
    db.savepoint("a")
    db.change("t_save", lambda t: changes.delete(t, F.col("id") == 1))
    assert db.query("select * from t_save").count() == 2
    db.rollback("a")
    assert db.query("select * from t_save").count() == 3
    with pytest.raises(ValueError, match="savepoint"):
        db.rollback("b")


ODD = [0.0, -0.0, -0.001, 0.005, -0.005, 0.015, 1.005, 0.125, -0.125, 0.375, -999.995, 999999.995, 1e15 + 0.25, 2.0**53 + 2, 2.0**70, -1e22, 5e-324, float("nan"), float("inf"), float("-inf"), None]


def test_format_goes_by_the_exact_value(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "c_custkey bigint, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    ours = registry.QUERIES["format"](spark, str(tmp_path)).select("c_custkey", "en", "de", "fr").orderBy("c_custkey").collect()
    with duckdb.connect() as duck:
        duck.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
        assert [tuple(r) for r in ours] == duck.sql(f"select * from ({registry.ORACLE_SQL['format']}) order by c_custkey").fetchall()


def test_format_of_other_types(spark):
    assert one(spark, strings.format_number(F.lit(1234567), 0)) == "1,234,567"
    assert one(spark, strings.format_number(F.lit("-1234.50").cast("decimal(10,2)"), 1, "es_ES")) == "-1.234,5"


def test_replayed_index_keeps_ids_that_new_rows_have_too(spark, tmp_path):
    rows = [(i, [1.0], i % 4) for i in (*range(20), *range(99_998, 100_008))] + [(None, [1.0], 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    ours = registry.QUERIES["hnsw_incr"](spark, str(tmp_path)).select("id", "label").collect()
    with duckdb.connect() as duck:
        duck.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        assert sorted(map(tuple, ours)) == sorted(duck.sql(registry.ORACLE_SQL["hnsw_incr"]).fetchall())


def test_keys_are_the_sides_of_the_planes(spark):
    rows = [(1, [0.5, -1.0, 2.0]), (2, [0.0, 0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, None, 1.0]), (6, [-0.5, 1.0, -2.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>").repartition(2)
    rng = random.Random(7)
    planes = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(4)]
    dots = [F.aggregate(F.zip_with("v", vector.literal(p), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x) for p in planes]
    bits = [F.when(F.size("v") == 3, d > 0).otherwise(False).cast("long") for d in dots]
    expected = F.when(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()), F.array(bits[0] + bits[1] * 2, bits[2] + bits[3] * 2 + 4))
    both = df.select("id", vector.hyperplane_keys(F.col("v"), 3, tables=2, bits=2).alias("keys"), expected.alias("expected")).collect()
    assert len(both) == 6 and all(r["keys"] == r["expected"] for r in both)
    assert {r["id"] for r in both if r["keys"] is None} == {4, 5}


def test_approximate_search_shuffles_no_vectors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = vector.hyperplane_index(e, "vec_id", "embedding", 64, tables=24, bits=3)
    query = list(e.filter("vec_id = 7").first()["embedding"])
    near = vector.approximate_knn(index, query, 20, tables=24, bits=3)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "first(vector" not in plan and plan.count("zip_with(") == 1  # no vectors are merged, and no plane is an expression
    read = {r["rowid"] for r in index.filter(F.col("key").isin(vector._keys(np.array([query], "f4"), 24, 3, 7)[0].tolist())).select("rowid").collect()}
    exact = vector.knn(e.filter(F.col("vec_id").isin(list(read))), "vec_id", "embedding", query, 20).collect()
    assert near.collect() == exact and exact[0]["rowid"] == 7
