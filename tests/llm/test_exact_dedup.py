from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup as E
from tidewater.llm.common import new_path


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t)).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@given(st.text("ab \t\n\x0b\x0c\r\x1c\xa0"))
def test_normalised(text):
    assert E.normalised(text) == norm(text)


def test_documents(documents):
    assert found(E.exact_groups(documents)) == expected([(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows(odd):
    assert found(E.exact_groups(odd)) == expected([(r.doc_id, r.text) for r in odd.collect()])


def test_empty(odd):
    assert E.exact_groups(odd.limit(0)).count() == 0


def test_many_buckets_and_collisions(spark, monkeypatch):
    rows = [(k, f"text {k % 40}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = E.exact_groups(df, capacity=2)
    assert out.select("bucket").distinct().count() > 8
    assert found(out) == expected(rows)


def test_chain_compares_bytes():
    rows = [(0, 5, b"a", 3, 1), (0, 5, b"b", 1, 2), (0, 5, b"a", 2, 4), (0, 6, b"a", 9, 1)]
    assert [(k, link, first, n) for _, k, link, _, first, n, _ in E._chained(rows)] == [(5, 0, 2, 5), (5, 1, 1, 2), (6, 0, 9, 1)]


def test_directory_doubles_and_splits():
    d = E.Directory()
    one = d.split(0)
    two = d.split(one)
    assert (d.depth, d.slots.tolist()) == (2, [0, 0, one, two])
    d.split(0)
    assert d.depth == 2 and len(set(d.slots.tolist())) == 4
    again = E.Directory.of_json(d.json())
    assert (again.depth, again.slots.tolist(), again.owns) == (d.depth, d.slots.tolist(), d.owns)
    assert [d.owns[b] for b in np.argsort(d.owners())] == sorted(d.owns)


@pytest.mark.parametrize("capacity", [1, 3, 10, 1000])
def test_directory_grows_by_loads(capacity):
    loads = [(k * 7) % 5 for k in range(64)]
    d = E.Directory().grow(np.cumsum([0, *loads]), 6, capacity)
    held = defaultdict(int)
    for k, n in enumerate(loads):
        held[int(d.slots[k >> (6 - d.depth)])] += n
    assert all(n <= capacity or d.owns[b][1] == 6 for b, n in held.items())
    assert sum(held.values()) == sum(loads)
    before = list(d.slots)
    d.grow(np.cumsum([0, *loads]), 6, capacity)
    assert list(d.slots) == before  # nothing is overfull any more


def test_index_is_reopened_and_grows(spark):
    """Two batches, the second through the files that the first left: as if all came at once, in more buckets."""
    rows = [(k, f"text {k % 150}") for k in range(400)]
    a, b = (spark.createDataFrame(x, "doc_id long, text string") for x in (rows[:30], rows[30:]))
    path = new_path(spark, "exact-test")
    E.exact_groups(a, index=E.HashIndex(spark, path, 20)).count()
    small = E.HashIndex(spark, path, 20).directory()
    out = found(E.exact_groups(b, index=E.HashIndex(spark, path, 20)))
    index = E.HashIndex(spark, path, 20)
    assert out == [x for x in expected(rows) if x[0] >= 30]
    assert index.version() == 2 and index.directory().depth > small.depth and len(index.directory().owns) > len(small.owns)
    assert index.chains().count() == 150
    assert all(r["most"] <= 40 for r in index.chains().groupBy("bucket").count().agg({"count": "max"}).toDF("most").collect())


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(20,0)", "string", "date", "timestamp", "double"])
def test_ids_of_any_type(spark, kind):
    ids = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "b")], "k int, text string")
    value = F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")) if kind in ("date", "timestamp") else F.col("k")
    out = E.exact_groups(ids.select(value.cast(kind).alias("doc_id"), "text"))
    assert out.schema["keep_id"].dataType == out.schema["doc_id"].dataType and sorted((r.group_size, r.kept) for r in out.collect()) == [(2, False), (2, False), (2, True), (2, True)]


def test_drop_copies_keeps_columns_and_other_rows_of_an_id(odd):
    kept = E.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id, r.text) for r in kept.filter("doc_id = 7").collect()) == [(7, "a"), (7, "b")]
    assert kept.filter("doc_id = 5").count() == 0
