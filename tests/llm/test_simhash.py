from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import simhash as S
from tidewater.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None), default=None) for g in group}
    return sorted(((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group, strict=True)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_documents(documents):
    assert found(S.near_duplicates(documents)) == plain_components([(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows(odd):
    assert found(S.near_duplicates(odd)) == plain_components([(r.doc_id, r.text) for r in odd.collect()])
    assert S.near_duplicates(odd.limit(0)).count() == 0


def test_fingerprint_equals_sparks_hash(spark):
    text = "One two Three four"
    shingles = ["one two three", "two three four"]
    hashes = [spark.sql("select xxhash64(:s) as h", args={"s": s}).first().h & (1 << 64) - 1 for s in shingles]
    assert S.fingerprint(text) & (1 << 64) - 1 == hashes[0] & hashes[1]


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_close_pairs(spark, few):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)] + [0, -1, 1, 3, 7, -(2**63)]
    points = sorted({(b ^ (1 << int(i)) ^ (1 << int(j)) if k else b) for b in base for k in range(4) for i, j in [rng.integers(0, 62, 2)]})
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    ours = [tuple(sorted(r)) for r in S.close_pairs(df, few=few).collect()]
    theirs = {(a, b) for a in points for b in points if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert len(ours) == len(set(ours)) and set(ours) == theirs


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_looks_are_not_broadcast(spark, tmp_path, few):
    spark.range(2000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/points")
    pairs = S.close_pairs(spark.read.parquet(f"{tmp_path}/points"), few=few)
    pairs.count()
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(200, 201), (201, 200), (300, 300), (None, 5)]
    df = spark.createDataFrame(edges, "u long, v long")
    out = dict(map(tuple, connected_components(df).collect()))
    assert out == {k: 100 for k in range(100, 141)} | {k: 1 for k in range(1, 60)} | {200: 200, 201: 200, 300: 300}
    assert connected_components(df.limit(0)).count() == 0


def test_drop_keeps_one_of_each(odd):
    kept = S.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert kept.filter("doc_id in (4, 5)").select("doc_id").distinct().collect() == [(4,)]
    assert kept.filter(F.col("doc_id").isNull()).count() == 2
