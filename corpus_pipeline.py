"""A corpus pipeline of five stages over `documents`; each stage works on what the one before kept.

Stages map (spark, docs, sf_dir) to a DataFrame. All but the last return the columns of documents; the last returns
each document's tokens. run() writes and rereads the documents between stages in the shared folder, so a lost
executor costs at most the stage it was in.
"""

from __future__ import annotations

from contextlib import ExitStack

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.bpe import encode_decode, read_spec
from tidewater.llm.common import saved, table
from tidewater.llm.decontaminate import drop_contaminated
from tidewater.llm.exact_dedup import drop_copies
from tidewater.llm.near_copies import drop_similar
from tidewater.llm.quality import drop_unselected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects."""
    return drop_unselected(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word similarities of 0.8 or more join, the one with the smallest doc_id."""
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of `benchmark`."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): each document's tokens, and the text that they give back."""
    return encode_decode(docs, read_spec(public_tokenizers.path("byte_bpe_50k.json")), ("n_tokens", "ids", "decoded"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokenize", tokenize)]

#: The quality model, near copies and BPE are beyond SQL; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`; what a stage has written goes once the next has read it."""
    docs = table(spark, sf_dir, "documents")
    with ExitStack() as before:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                now = ExitStack()
                docs = now.enter_context(saved(spark))(docs, f"pipeline-{name}", keep=k == len(STAGES) - 2)
                before.close()
                before.push(now)
    return docs
