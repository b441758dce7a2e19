from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm.decontaminate import MASKS, contaminated, drop_contaminated


def plain(docs, items, overlap=0.5):
    """Every diagonal of every pair; a hit needs one mask to fit, or all tokens of a short item."""
    known = {}
    words = lambda t: np.array([known.setdefault(x, len(known)) for x in (t or "").encode().lower().split()], int)
    masks = [np.array([c == "1" for c in m]) for m in MASKS]
    items, out = [(i, words(t)) for i, t in items], set()
    for d, text in docs:
        w = words(text)
        for i, v in items:
            n = len(v)
            if not n or not len(w):
                continue
            padded = np.concatenate([np.full(n - 1, -1), w, np.full(n - 1, -1)])
            same = np.lib.stride_tricks.sliding_window_view(padded, n) == v  # a row for each diagonal
            if n < min(map(len, MASKS)):
                hit, least = same.all(1), 1.0
            else:
                inside = np.lib.stride_tricks.sliding_window_view(padded >= 0, n)
                hit, least = np.zeros(len(same), bool), overlap
                for m in masks:
                    if n >= len(m):
                        fits = (np.lib.stride_tricks.sliding_window_view(same, len(m), axis=1) | ~m).all(2) & np.lib.stride_tricks.sliding_window_view(inside, len(m), axis=1).all(2)
                        hit |= fits.any(1)
            if (hit & (same.sum(1) >= least * n)).any():
                out.add((d, i))
    return out


def found(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_cases(spark):
    items = [(1, "alpha beta gamma delta eps zeta eta theta iota kappa"), (2, "red fox"), (3, None), (4, ""), (5, "one two three four five six seven eight nine ten")]
    docs = [(1, "x ALPHA beta gamma QQ eps zeta eta theta iota zz"), (2, "the Red\tFox ran"), (3, "red foxes"), (4, None), (5, ""), (6, "alpha beta"), (7, "four five six seven eight nine ten"), (8, "alpha x gamma x eps x eta x iota x"), (9, "ten one two three four five six seven eight nine ten one two three")]
    i, d = spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")
    assert found(contaminated(d, i)) == plain(docs, items) == {(1, 1), (2, 2), (7, 5), (9, 5)}


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "no id"), (2, "héé 漢字"), (3, None)], "item_id int, text string")
    assert found(contaminated(odd, items)) == {(None, 1), (8, 2)}
    assert contaminated(odd.limit(0), items).count() == 0 and contaminated(odd, items.limit(0)).count() == 0
    kept = drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2


def test_documents(spark, sf_dir, documents):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    some = documents.filter(F.length("text") < 3000)
    assert found(contaminated(some, benchmark)) == plain([(r.doc_id, r.text) for r in some.collect()], items)


def test_equal_words(spark):
    """A long document of one word, and items of the same word: each diagonal is a hit, and none is kept in one row with all."""
    docs = spark.createDataFrame([(1, "same " * 20_000), (2, "other " * 50)], "doc_id int, text string")
    items = spark.createDataFrame([(k, "same " * 40) for k in range(6)], "item_id int, text string")
    out = contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(1, k) for k in range(6)} and {r.overlap for r in out} == {1.0}


def test_recall_against_plain_overlap(spark):
    """Items with a part of their tokens replaced, wherever they stand: what share the masks find."""
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randrange(5_000)
    items = [(k, [word() for _ in range(20 + k % 40)]) for k in range(200)]
    docs = [(k, [word() for _ in range(30)] + [word() if rng.random() < 0.1 else t for t in item] + [word() for _ in range(30)]) for k, item in items]
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(x)) for k, x in rows], f"{name} int, text string")
    out = found(contaminated(frame(docs, "doc_id"), frame(items, "item_id")))
    assert len({(k, k) for k, _ in items} & out) >= 0.98 * len(items)
