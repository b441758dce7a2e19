from __future__ import annotations

from collections import defaultdict

import pytest

from tidewater.llm.line_dedup import dedup_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, min_chars=10, min_docs=2):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < min_chars or len(held[key(x)]) < min_docs or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("min_chars", "min_docs"), [(10, 2), (5, 3)])
def test_documents(documents, min_chars, min_docs):
    assert found(dedup_lines(documents, min_chars, min_docs)) == expected([(r.doc_id, r.text) for r in documents.collect()], min_chars, min_docs)


def test_cases(spark):
    rows = [(3, "A shared line\nown\n a SHARED line\t"), (1, "a shared line\n\na shared line"), (2, "short\nshort"), (4, None), (5, ""), (None, "a shared line"), (6, "ÉCLAIR grandé\n"), (7, "éclair grandé"), (3, "A shared line"), (8, "1234567890\r"), (9, "1234567890")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(dedup_lines(df)) == expected(rows)


def test_odd_rows(odd):
    assert found(dedup_lines(odd)) == expected([(r.doc_id, r.text) for r in odd.collect()])
    assert dedup_lines(odd.limit(0)).count() == 0


def test_hot_line(spark):
    rows = [(k, f"the very same line here\nline {k} of its own") for k in range(3000)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.filter("n_dropped = 1").count() == 2999 and out.filter("doc_id = 0 and n_dropped = 0").count() == 1
