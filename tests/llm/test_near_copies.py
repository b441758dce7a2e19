from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidewater.llm import near_copies as N


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows):
    """Each row's least id over chains of Jaccard similarities of 0.8 or more, by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if group[a] != group[b] and (sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None), default=None) for g in group}
    return sorted(((i, least[g]) for (i, _), g in zip(rows, group, strict=True)), key=repr)


def found(df):
    return sorted(((r.doc_id, r.component_id) for r in df.collect()), key=repr)


def edited(rng, words, n):
    """The words with n of them replaced."""
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    """Texts with edits that leave similarities on both sides of 0.8, and chains of such edits."""
    rng = random.Random(7)
    rows = []
    for _ in range(40):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 30, 90, 200]))]
        rows.append(" ".join(text))
        for n in range(1, 6):
            rows.append(edited(rng, text, max(1, len(text) * n // 200)))
        rows.append(edited(rng, rows[-1].split(), max(1, len(text) // 60)))
    return list(enumerate(rows))


def test_copies(spark, copies):
    ours = found(N.near_copies(spark.createDataFrame(copies, "doc_id long, text string")))
    assert ours == plain_components(copies) and 40 < len({c for _, c in ours}) < len(copies)


def test_stage_drops_copies_beyond_two_bits(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {c for _, c in plain_components(copies)}


def test_simhash_links_what_its_bits_reach(spark, copies, monkeypatch):
    """Without the rounds of bands, the stage links similar texts by the grid join over fingerprints alone."""
    monkeypatch.setattr(N, "rounds", lambda: iter(()))
    rows = list({N.word_mark(t): (k, t) for k, t in copies if len(t.split()) >= 90}.values())
    sets = {k: N.shingle_set(t) for k, t in rows}
    marks, wide = {k: N.word_mark(t) for k, t in rows}, {k: N.majority(x) for k, x in sets.items()}

    def apart(a, b):
        return ((a ^ b) & (1 << 64) - 1).bit_count()

    def linked(a, b):
        both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
        return apart(marks[a], marks[b]) <= N.BITS and apart(wide[a], wide[b]) <= N.WIDE_BITS and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)

    ids = sorted(sets)
    group = {k: k for k in ids}
    for a in ids:
        for b in ids:
            if b < a and linked(a, b) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    ours = dict(found(N.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert len(set(group.values())) < len(ids) and all(ours[k] == ours[g] for k, g in group.items())
    assert len(set(ours.values())) > len(set(dict(plain_components(rows)).values()))


def test_large_bands(spark, monkeypatch):
    """With one leader and one hash for each band, bands are large and hold unlike texts; nothing is left out for that."""
    monkeypatch.setattr(N, "LEADERS", 1)
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(60)]
    hub = shared + [f"h{k}" for k in range(60)]
    rows = [(k, " ".join(shared + [f"x{rng.randrange(10**9)}" for _ in range(60)])) for k in range(20)]
    rows += [(100 + k, edited(rng, hub, 2)) for k in range(40)] + [(200, " ".join(hub))]
    assert found(N.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_components(rows)


def test_odd_rows(odd):
    assert found(N.near_copies(odd)) == plain_components([(r.doc_id, r.text) for r in odd.collect()])
    assert N.near_copies(odd.limit(0)).count() == 0
    kept = N.drop_similar(odd)
    assert kept.columns == odd.columns and kept.filter(F.col("doc_id").isNull()).count() == 2


def test_documents(documents):
    assert found(N.near_copies(documents)) == plain_components([(r.doc_id, r.text) for r in documents.collect()])
