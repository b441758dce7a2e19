from __future__ import annotations

import corpus_pipeline
from tests.llm.test_decontaminate import plain


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        before, kept = kept, {r.doc_id: r.text for r in docs.collect()}
        gone = before.keys() - kept.keys()
        if name == "quality":
            good, bad = ([k for k, q in labels.items() if q == x and k in before] for x in (1, 0))
            assert sum(k in kept for k in good) >= 0.98 * len(good) and sum(k in gone for k in bad) >= 0.9 * len(bad)
        elif name == "exact_dedup":
            first = {}
            for k in sorted(before):
                first.setdefault(" ".join(before[k].split(" ")), k)
            assert kept.keys() == set(first.values())
        elif name == "near_dedup":
            sets = {k: shingles(t) for k, t in before.items()}
            near = {k: {j for j in before if similar(sets[j], sets[k])} for k in before}
            group = dict(zip(before, before, strict=True))
            for _ in before:
                new = {k: min(group[j] for j in near[k]) for k in before}
                if new == group:
                    break
                group = new
            assert kept.keys() == set(group.values())
        else:
            assert gone == {k for k, _ in plain([(k, t) for k, t in before.items() if len(t) < 20_000], items)} | {k for k in gone if len(before[k]) >= 20_000}
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id: r.decoded for r in tokens} == kept and all(r.n_tokens == len(r.ids) for r in tokens)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids", "decoded"]
