from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm.quality import BUCKETS, drop_unselected, expected_share, features, kth_largest, resample, shape


@pytest.mark.parametrize(("chunk", "kind"), [("Hello,", "Aa,"), ("the###", "a#"), ("A1b2", "x"), ("2024", "9"), ("!!", "!"), ("", "")])
def test_shape(chunk, kind):
    assert shape(chunk) == kind


def test_features_see_repeats():
    assert len(features("a b c")) == 12 and len(features(None)) == len(features(" ")) == 0
    assert not np.array_equal(features("cat cat")[4:6], features("cat dog")[4:6])


@pytest.fixture(scope="module")
def some(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet").cache(), spark.read.parquet(f"{d}/labels.parquet").cache()


def test_held_out_labels(some):
    """Fitted on a part of the labels, it must part the others too."""
    docs, labels = some
    fit, rest = labels.filter("doc_id % 5 <> 0"), labels.filter("doc_id % 5 = 0")
    out = resample(docs, fit)
    right = out.join(rest, "doc_id").agg(F.avg((F.col("selected") == (F.col("quality") == 1)).cast("int")).alias("v"), F.count(F.lit(1)).alias("n")).first()
    assert right.n > 50 and right.v > 0.97


@pytest.mark.parametrize("share", [0.3, 0.6])
def test_gumbel_top_k(some, share):
    """Against a plain top k of weight plus noise with the same uniforms; it is no plain cut, and nearer to the target than the rest."""
    docs, labels = some
    rows = resample(docs, labels, share=share).withColumn("_u", (F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))).collect()
    k = round(share * len(rows))
    key = {r.doc_id: r.log_weight - np.log(-np.log(r["_u"])) for r in rows}
    chosen = {r.doc_id for r in rows if r.selected}
    assert chosen == set(sorted(key, key=lambda i: -key[i])[:k])
    cut = {r.doc_id for r in sorted(rows, key=lambda r: -r.log_weight)[:k]}
    assert len(chosen ^ cut) > 0.05 * k
    texts, good = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id for r in labels.filter("quality = 1").collect()}
    model = lambda ids: sum(np.bincount(features(texts[i]), minlength=BUCKETS) for i in ids) + 0.5
    target = model(good) / model(good).sum()
    away = lambda ids: float((target * np.log(target / (model(ids) / model(ids).sum()))).sum())
    assert away(chosen) < away(texts)


def test_share_sees_all_rows_of_a_hot_id(spark):
    sample = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, _label int")
    hot = spark.range(0, 45_000, 1, 1).select(F.lit(1).cast("long").alias("doc_id"), (F.lit(4.0) + F.col("id") / 1e6).alias("log_weight"))
    few = spark.createDataFrame([(2, -30.0), (3, -50.0), *((4, -40.0) for _ in range(5_000))], "doc_id long, log_weight double")
    assert abs(expected_share(hot.union(few), sample, "doc_id") - 0.9) < 0.01
    assert expected_share(hot, sample, "doc_id") == 1.0


def test_kth_largest(spark):
    values = [float(v) for v in [5, 1, 1, 1, 9, -3, 7, 7, 2]] + [1e-9 * k for k in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 3, 5, 8, 20, len(values) - 1):
        assert kth_largest(df, "v", k, bins=4, few=2) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, "v", len(values)) == -np.inf and kth_largest(df, "v", 0) == np.inf


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(8, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    out = resample(odd, labels)
    assert out.count() == odd.count()
    assert out.filter("log_weight = 0").count() >= 4  # null, empty and blank texts
    assert drop_unselected(odd, labels).columns == odd.columns
    assert resample(odd, labels.limit(0)).filter("not selected").count() == 0
    assert resample(odd.limit(0), labels).count() == 0
