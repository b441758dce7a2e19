from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import toxicity as X
from tidewater.llm.common import fit_logistic


def test_index_is_exact():
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(700):
        terms = np.sort(rng.choice(60, rng.integers(1, 6), replace=False))
        w = rng.random(len(terms))
        vectors.append((terms, w / np.sqrt((w * w).sum())))
    index = X.BlockMaxIndex(vectors, [k % 2 for k in range(700)], list(range(700)), np.ones(700), 60)
    dense = np.zeros((700, 60))
    for row, (t, w) in enumerate(vectors):
        dense[row, t] = w
    for _ in range(60):
        terms = np.sort(rng.choice(60, 3, replace=False))
        w = rng.random(3)
        q = np.zeros(60)
        q[terms] = w
        near = index.search(terms, w, 10)
        assert np.allclose([s for s, _ in near], np.sort(dense @ q)[::-1][:10])
        assert all(np.isclose(dense[index.ids[i]] @ q, s) for s, i in near)


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").cache(), spark.read.parquet(f"{d}/labels.parquet").cache()
    return docs, labels, X.toxicity(docs, labels).cache()


def test_scores_as_brute_force(scored):
    """Every text against every example, all terms, in plain dense vectors."""
    docs, labels, out = scored
    texts, label = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    counts = {i: Counter(re.findall(r"[^\W_]+", t.lower())) for i, t in texts.items()}
    own = sorted((i for i in label if zlib.crc32(str(i).encode()) % 5), key=str)
    toxic, clean = (Counter(t for i in own if label[i] == k for t in counts[i]) for k in (1, 0))
    terms = sorted(t for t in toxic | clean if toxic[t] + clean[t] >= 2)
    at = {t: k for k, t in enumerate(terms)}
    df = Counter(t for c in counts.values() for t in c)
    weight = np.array([np.log(1 + len(texts) / df[t]) * np.log2(2 + toxic[t] / max(1, clean[t])) ** 2 for t in terms])

    def vector(i):
        v = np.zeros(len(terms))
        for t, n in counts[i].items():
            if t in at:
                v[at[t]] = (1 + np.log(n)) * weight[at[t]]
        return v / (np.linalg.norm(v) or 1)

    dense = np.array([vector(i) for i in own])

    def vote(i, skip=None):
        cos = dense @ vector(i)
        near = sorted((k for k in range(len(own)) if k != skip and cos[k] > 1e-12), key=lambda k: -cos[k])[: X.NEIGHBOURS]
        return sum(cos[k] for k in near if label[own[k]]) / (sum(cos[k] for k in near) + X.DOUBT), sorted((round(float(cos[k]), 5) for k in near), reverse=True)

    votes = [vote(i, k)[0] for k, i in enumerate(own)]
    slope, shift = fit_logistic(np.array(votes), np.array([label[i] for i in own], float), np.ones(len(own)), (4.0, -2.0))
    for r in out.filter("doc_id % 7 = 0").collect():
        if counts[r.doc_id].keys() & at.keys():
            v, near = vote(r.doc_id)
            assert abs(r.score - 1 / (1 + np.exp(-(slope * v + shift)))) < 1e-3
            assert np.allclose([round(e.cosine, 5) for e in r.evidence], near, atol=2e-5)


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = X.toxicity(docs, labels).cache()
    assert out.count() == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.limit(500).collect())
    n = {(r.toxic, r.predicted): r["count"] for r in out.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n[1, 1] >= 0.9 * (n[1, 1] + n.get((0, 1), 0))
    assert out.filter("size(evidence) = 0").join(docs.filter("length(text) > 50"), "doc_id").count() == 0  # every text has neighbours
    copies = docs.join(out.select("doc_id", "score"), "doc_id").groupBy("text").agg(F.countDistinct("score").alias("n")).filter("n > 1")
    assert copies.count() == 0  # a score is a function of the text


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = X.toxicity(odd, labels)
    assert out.count() == odd.count() and out.filter("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    assert X.toxicity(odd, labels.limit(0)).filter("score = 0").count() == odd.count()
    assert X.toxicity(odd.limit(0), labels).count() == 0
