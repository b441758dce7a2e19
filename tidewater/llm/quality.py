"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import fit_logistic, python_ready, python_task, saved, slices, without

#: Labelled documents that the target model and the curve of the expected share are fitted on, at most; the raw model is of all documents.
MAX_LABELLED = 20_000
#: Of FOLDS parts of the labelled ids one is for the curve, the others for the target model.
FOLDS = 4
#: Buckets for words, pairs of words, shapes and pairs of shapes: one hashed space after the other.
WORD, WORDS, SHAPE, PAIR = 1 << 13, 1 << 14, 1 << 11, 1 << 13
FAMILIES = ((0, WORD), (WORD, WORD + SHAPE), (WORD + SHAPE, WORD + SHAPE + PAIR), (WORD + SHAPE + PAIR, WORD + SHAPE + PAIR + WORDS))
BUCKETS = FAMILIES[-1][1]
#: Scale of the Gumbel noise; at 1 a document is drawn in proportion to its weight.
TEMPERATURE = 1.0
#: Of how many n-grams a text counts, at most: its n-grams depend on each other, and their plain sum would drown the noise.
GRAMS = 32
#: Added to each count, as a share of the family's mean count.
SMOOTHING = 0.3
#: Chunks kept by each worker before it starts anew.
CACHE = 100_000


_MIXED = re.compile("(?:[aA]+9|9+[aA])[aA9]*").sub


def shape(chunk: str) -> str:
    """Runs of lower case as a, of upper case as A, of digits as 9, of digits with letters as x; others as they are, repeats as one."""
    out = ""
    for c in chunk:
        c = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c
        if out[-1:] != c:
            out += c
    return _MIXED("x", out)


class _Chunks(dict):
    """By chunk: its word's bucket and its shape's, in one number."""

    def __missing__(self, chunk: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        kind = "a" if chunk.islower() and chunk.isalpha() else shape(chunk)
        word = chunk if kind == "a" else "".join(c for c in chunk.lower() if c.isalnum())
        found = (xxhash.xxh32_intdigest(word) % WORD) * SHAPE + xxhash.xxh32_intdigest(kind) % SHAPE
        if len(chunk) <= 64:
            self[chunk] = found
        return found


_chunks = _Chunks()


def known_chunks() -> _Chunks:
    """The worker's own; a nested function that named it would be sent with a copy."""
    return _chunks


def features(text: str | None) -> np.ndarray:
    """The buckets of a text's n-grams: each chunk's word, its shape, and both with those of the chunk before.

    A chunk that repeats the one before makes another pair of shapes than one of the same shape.
    """
    chunks = (text or "").split()
    if not chunks:
        return np.zeros(0, np.int64)
    ids = np.fromiter(map(_chunks.__getitem__, chunks), np.int64, len(chunks))
    own, words = ids % SHAPE, ids // SHAPE
    pairs, both = own * 2654435761, words * 2654435761
    pairs[1:] += own[:-1] * 40503 + 97 * (ids[1:] == ids[:-1])
    both[1:] += words[:-1] * 40503 + 1
    return np.concatenate([words, FAMILIES[1][0] + own, FAMILIES[2][0] + (pairs ^ (pairs >> 15)) % PAIR, FAMILIES[3][0] + (both ^ (both >> 15)) % WORDS])


def labelled_sample(labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id_col, _label) of at most `most` labelled ids, the first by a hash; of an id's labels the largest counts."""
    one = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_label")).dropna().groupBy(id_col).agg(F.max("_label").alias("_label"))
    return one.orderBy(F.xxhash64(id_col), id_col).limit(most)


def ngram_models(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """The log ratio of the target model (label 1 in the sample) to the raw model (all documents) for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task(known_chunks()):
            raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
            for batch in slices(batches):
                for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    n = np.bincount(features(text.as_py()), minlength=BUCKETS)
                    raw += n
                    if label == 1:
                        good += n
            some = np.flatnonzero(raw)
            yield pa.RecordBatch.from_arrays([pa.array(x[some] if k else some, pa.int64()) for k, x in enumerate((some, raw, good))], ["bucket", "raw", "good"])

    told = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(sample), id_col, "left").select("_text", "_label")
    sums = told.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    counts = np.zeros((2, BUCKETS))
    for bucket, raw, good in sums.collect():  # at most BUCKETS rows
        counts[:, bucket] = raw, good
    out = np.zeros(BUCKETS)
    for a, b in FAMILIES:
        part = counts[:, a:b]
        if part[1].sum():
            share = part / part.sum(1, keepdims=True)
            # smoothed towards the raw model, so a bucket that the small target sample lacks by chance says little
            rare = SMOOTHING * part[1].sum() / (b - a)
            good = (part[1] + rare * share[0] * (b - a)) / (part[1].sum() * (1 + SMOOTHING))
            out[a:b] = np.log(np.maximum(good, 1e-300) / np.maximum(share[0], 1e-300), where=share[0] > 0, out=np.zeros(b - a))
    return out


def log_weights(docs: DataFrame, ratio: np.ndarray, grams: int = GRAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, row, log_weight, n_chunks): the log ratio of a whole text's likelihoods; 0 for texts without chunks.

    It is the sum over all n-grams of the text, times grams over their number where there are more than that.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task(known_chunks()):
            for batch in slices(batches):
                found = [features(x.as_py()) for x in batch.column(2)]
                sums = [float(sent.value[x].sum()) * min(1.0, grams / max(1, len(x))) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.float64()), pa.array([len(x) // len(FAMILIES) for x in found], pa.int64())], [id_col, "row", "log_weight", "n_chunks"])

    schema = T.StructType([docs.schema[id_col], T.StructField("row", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("n_chunks", T.LongType())])
    return docs.select(F.col(id_col), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("_text")).mapInArrow(weigh, schema)


def _step(col: str) -> Column:
    """A log weight in steps of 1/64 between -40 and 40: so few values that a histogram of them is small."""
    return F.round(F.least(F.lit(40.0), F.greatest(F.lit(-40.0), F.col(col))) * 64).cast("int")


def expected_share(weighed: DataFrame, sample: DataFrame, id_col: str) -> float:
    """The mean of the documents' chances of label 1, by a logistic curve over log_weight, fitted on the sample; 1 without both labels."""
    told = weighed.join(F.broadcast(sample), id_col).groupBy(_step("log_weight"), "_label").count()
    rows = np.array(told.collect(), float).reshape(-1, 3)  # a histogram, so repeated rows count without being collected
    if set(rows[:, 1]) != {0.0, 1.0}:
        return 1.0
    slope, shift = fit_logistic(rows[:, 0] / 64, rows[:, 1], rows[:, 2], (1.0, 0.0))
    all_of = np.array(weighed.groupBy(_step("log_weight")).count().collect(), float).reshape(-1, 2)
    return float((all_of[:, 1] / (1 + np.exp(-np.clip(slope * all_of[:, 0] / 64 + shift, -30, 30)))).sum() / max(1.0, all_of[:, 1].sum()))


def kth_largest(keys: DataFrame, col: str, k: int, bins: int = 4096, few: int = 4096) -> float:
    """The k-th largest value, by counting values in bins of ever smaller ranges: no sort, and few values at the driver."""
    low, high, n = keys.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    above = 0
    while True:
        inside = keys.filter((F.col(col) >= low) & (F.col(col) <= high))
        step = (high - low) / bins
        counts = dict(inside.groupBy(F.least(F.lit(bins - 1), F.floor((F.col(col) - low) / step)).cast("int") if step > 0 else F.lit(0)).count().collect())
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= k:
                break
            above += counts[b]
        low, high = (low + b * step, low + (b + 1) * step) if step > 0 else (low, high)
        ends = keys.filter((F.col(col) >= low) & (F.col(col) <= high)).groupBy(col).count()
        if counts[b] <= few or not step > 0 or high - low <= 1e-12 * max(1.0, abs(low)):
            over = keys.filter(F.col(col) > high).count()
            for value, m in sorted(ends.collect(), reverse=True):
                over += m
                if over >= k:
                    return value
            return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, max_labelled: int = MAX_LABELLED, temperature: float = TEMPERATURE, grams: int = GRAMS, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, row, log_weight, n_chunks, key, selected) for each row: the Gumbel top-k sample of good documents.

    log_weight is the log ratio of two hashed n-gram models of the whole text, brought to `grams` n-grams: target,
    fitted on documents with label 1 among at most max_labelled labelled ones, and raw, fitted on all. key adds Gumbel
    noise, drawn from a hash of id and text, times the temperature; the k rows with the largest keys are selected,
    with all ties of the last, so at temperature 1 documents are drawn without replacement in proportion to their
    weights. k is `share` of the rows; by default the share of good documents to be expected, by a curve that a part
    of the labelled ids is kept for. row is a hash of the text, which tells rows apart that share an id.

    Null, empty and blank texts have log_weight 0. Without labels of both classes all rows are selected, unless share
    says otherwise. Repeated rows fare alike; empty tables give empty results; other columns are left out. Two passes
    over the texts; the models have a fixed size, and only keys are written and ranked.
    """
    spark = python_ready(docs)
    with saved(spark) as save:
        sample = save(labelled_sample(labels, label_col, max_labelled, id_col), "quality-sample")
        kept_back = F.pmod(F.xxhash64(F.lit(1), id_col), F.lit(FOLDS)) == 0
        ratio = ngram_models(docs, sample.filter(~kept_back), id_col, text_col)
        weighed = save(log_weights(docs, ratio, grams, id_col, text_col), "quality-weights", keep=True)
        if share is None:
            share = expected_share(weighed, sample.filter(kept_back), id_col)
    uniform = (F.shiftrightunsigned(F.xxhash64(id_col, "row"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = weighed.withColumn("key", F.col("log_weight") - F.lit(temperature) * F.log(-F.log(uniform)))
    last = kth_largest(keyed, "key", round(share * weighed.count()))
    return keyed.withColumn("selected", F.col("key") >= F.lit(last))


def drop_unselected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that resample selects, with their columns."""
    gone = resample(docs, labels, id_col=id_col, text_col=text_col, **options).filter("not selected").select(F.col(id_col).alias("_gone"), "row")
    return without(docs, gone, id_col, text_col, "quality-gone")
