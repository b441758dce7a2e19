from __future__ import annotations

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, shared ids, and columns with clashing names."""
    long = "word " * 30_000 + "\n" + "x" * 100_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "no id"), (None, None), (4, "Twice  the same"), (4, "Twice  the same"), (5, "Twice the same"), (6, long), (7, "a"), (7, "b"), (8, "héé 漢字 \x1c😀 <|endoftext|>  x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("_id", "_text", "row", "fp", "bucket", "link", "_label", "score", "n_tokens", "host", "path", "_hits", "item_id", "shard_id", "lang", "source", "_file", "_run", "_own", "_node", "_n", "_slice", "_slices", "_given", "_key", "_row", "_gone", "_lost")})
