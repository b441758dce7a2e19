"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, and weighted votes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import fit_logistic, python_ready, python_task, saved, slices

#: Labelled examples of each class in the index, at most, and terms in its vocabulary.
MAX_TOXIC, MAX_CLEAN, MAX_TERMS = 2000, 4000, 1 << 17
#: Examples that a term must be in to have a weight: what one text alone holds can be near to nothing.
LEAST_EXAMPLES = 2
#: Neighbours that vote, examples in a block, and blocks that a search opens at first.
NEIGHBOURS, BLOCK, WAVE = 16, 64, 4
#: A term in one of so many examples or more also has a row of weights over all examples: at most FREQUENT times the postings.
FREQUENT = 8
#: Votes of no label that are added, so that weak similarity says little.
DOUBT = 0.1

_WORDS = re.compile(r"[^\W_]+").findall


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def examples(labels: DataFrame, label_col: str, most: Sequence[int], id_col: str) -> DataFrame:
    """(id_col, _label) of the learning rows: the first by a hash of each label, at most most[label]."""
    one = labels.select(id_col, F.col(label_col).cast("int").alias("_label")).dropna().groupBy(id_col).agg(F.max("_label").alias("_label")).filter(~held_out(F.col(id_col)))
    parts = [one.filter(F.col("_label") == k).orderBy(F.xxhash64(id_col), id_col).limit(n) for k, n in enumerate(most)]
    return parts[0].union(parts[1])


def words_of(texts: DataFrame) -> DataFrame:
    """(_label, term): the different words of each row's whole text, in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task():
            for batch in slices(batches):
                found = [list(set(_WORDS((x.as_py() or "").lower()))) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["_label", "terms"])

    out = texts.select("_label", "_text").mapInArrow(run, "_label int, terms array<string>")
    return out.select("_label", F.explode("terms").alias("term"))


def term_counts(docs: DataFrame, keep: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """(*keep, terms, counts): the vocabulary's terms in each whole text of column _text."""
    sent = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})  # at most max_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task():
            known = sent.value.get
            for batch in slices(batches):
                which, counts, ends = [], [], [0]
                for text in batch.column(len(keep)):
                    seen = Counter(map(known, _WORDS((text.as_py() or "").lower())))
                    seen.pop(None, None)
                    own = sorted(seen)
                    which += own
                    counts += map(seen.__getitem__, own)
                    ends.append(len(which))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (which, counts)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *lists], [*keep, "terms", "counts"])

    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("terms", "counts"))])
    return docs.select(*keep, "_text").mapInArrow(run, schema)


def document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """In how many rows each term is. A task sends a row for each term that it has seen, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task():
            sums = np.zeros(size, np.int64)
            for batch in batches:
                sums += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some], pa.int64())], ["term", "n"])

    out = np.zeros(size, np.int64)
    for term, n in counted.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # at most max_terms rows
        out[term] = n
    return out


def term_weights(frequency: np.ndarray, rows: int, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Of each term: inverse document frequency times the square of its relevance frequency.

    Relevance frequency is log2(2 + toxic / max(1, clean)), of the examples that hold the term: at least 1, so every
    term counts, and more for those that toxic examples have more often.
    """
    return np.log(1 + rows / np.maximum(frequency, 1)) * np.log2(2 + toxic / np.maximum(clean, 1)) ** 2


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class BlockMaxIndex:
    """Postings by term and block of examples, with the largest weight of each term in each block."""

    def __init__(self, vectors: Sequence[tuple[np.ndarray, np.ndarray]], labels: Sequence[int], ids: Sequence, weights: Sequence[float], size: int):
        """vectors: terms below size and unit-length weights of each example; weights: how many documents each stands for."""
        # examples with the same main term lie together, so that the other blocks' bounds are low
        order = sorted(range(len(vectors)), key=lambda k: (int(vectors[k][0][np.argmax(vectors[k][1])]) if len(vectors[k][0]) else -1, k))
        self.labels, self.ids, self.weights = np.array([labels[k] for k in order], float), [ids[k] for k in order], np.array([weights[k] for k in order], float)
        self.blocks = -(-len(order) // BLOCK)
        term = np.concatenate([vectors[k][0] for k in order] or [np.zeros(0, np.int64)])
        at = np.repeat(np.arange(len(order)), [len(vectors[k][0]) for k in order])
        by_term = np.argsort(term, kind="stable")  # and by example within a term
        term, self.at = term[by_term], at[by_term].astype(np.int32)
        self.of = np.concatenate([vectors[k][1] for k in order] or [np.zeros(0)])[by_term].astype(np.float32)
        block = self.at // BLOCK
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.start, self.length, self.block = first.astype(np.int32), np.diff(np.append(first, len(term))).astype(np.int32), block[first]
        self.most = np.maximum.reduceat(self.of, first) if len(first) else np.zeros(0, np.float32)
        # where a term's entries, a block each, and its postings begin
        self.entries, self.postings = np.searchsorted(term[first], np.arange(size + 1)), np.searchsorted(term, np.arange(size + 1))
        # the frequent terms' weights in every example, and each term's row there
        often = np.flatnonzero(FREQUENT * np.diff(self.postings) >= max(len(order), 1))
        self.row, self.dense = np.full(size, -1, np.int32), np.zeros((len(often), len(order)))
        self.row[often] = np.arange(len(often))
        for k, t in enumerate(often):
            own = slice(self.postings[t], self.postings[t + 1])
            self.dense[k, self.at[own]] = self.of[own]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a term in common, nearest first; of equally near ones the first.

        The WAVE blocks of the highest bounds are opened first, then those whose bound reaches the k-th cosine found, so it
        is exact; where these are most blocks, all that the terms have is read through instead.
        """
        first = self.entries[terms]
        lengths = self.entries[terms + 1] - first
        entry, by = _ranges(first, lengths), np.repeat(weights, lengths)
        block = self.block[entry]
        bound = np.bincount(block, by * self.most[entry], self.blocks)
        some = np.zeros(self.blocks, bool)
        some[np.argsort(-bound, kind="stable")[:WAVE]] = True
        sums = self._opened(entry, by, some[block], skip)
        least = max(self._least(sums[sums > 0], k) - 1e-9, 1e-12)
        rest = (bound >= least) & ~some
        if 4 * rest.sum() > self.blocks:
            sums = self._read_through(terms, weights, skip)
        elif rest.any():
            sums = self._opened(entry, by, (rest | some)[block], skip)
        near = np.flatnonzero(sums >= least)
        near = near[sums[near] >= self._least(sums[near], k) - 1e-11]
        near = near[np.lexsort((near, -np.round(sums[near], 12)))[:k]]
        return list(zip(sums[near].tolist(), near.tolist(), strict=True))

    def _least(self, sums: np.ndarray, k: int) -> float:
        """The k-th largest sum; 0 where there are fewer than k."""
        return np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) >= k else 0.0

    def _opened(self, entry: np.ndarray, by: np.ndarray, some: np.ndarray, skip: int) -> np.ndarray:
        """Each example's sum over some of the entries."""
        own = entry[some]
        n = self.length[own]
        return self._sums(_ranges(self.start[own], n), np.repeat(by[some], n), skip)

    def _read_through(self, terms: np.ndarray, weights: np.ndarray, skip: int) -> np.ndarray:
        """Each example's sum over all terms: frequent ones by their rows, others by their postings."""
        row = self.row[terms]
        often = row >= 0
        first = self.postings[terms[~often]]
        lengths = self.postings[terms[~often] + 1] - first
        sums = weights[often] @ self.dense[row[often]] + self._sums(_ranges(first, lengths), np.repeat(weights[~often], lengths), skip)
        if skip >= 0:
            sums[skip] = 0
        return sums

    def _sums(self, posting: np.ndarray, by: np.ndarray, skip: int) -> np.ndarray:
        sums = np.bincount(self.at[posting], by * self.of[posting], len(self.ids))
        if skip >= 0:
            sums[skip] = 0
        return sums

    def vote(self, found: Sequence[tuple[float, int]]) -> float:
        """The share of toxic votes, each weighed by its cosine and by how many documents the example stands for."""
        near = np.array([s for s, _ in found]) * self.weights[[i for _, i in found]]
        return float((near * self.labels[[i for _, i in found]]).sum() / (near.sum() + DOUBT))


def unit(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms and their weights in a vector of length 1."""
    terms = np.asarray(terms, np.int64)
    w = (1 + np.log(np.asarray(counts, float))) * weights[terms]
    return terms, w / (np.sqrt((w * w).sum()) or 1)


def _lists(batch: pa.RecordBatch, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The terms and counts of each row, from two columns of lists."""
    (ends, terms), (_, counts) = ((np.asarray(c.offsets), np.asarray(c.values)) for c in (batch.column(first), batch.column(first + 1)))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield terms[a:b], counts[a:b]


def own_votes(of_examples: DataFrame, sent, neighbours: int, stands: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vote on each example by its neighbours, itself left out; its label; and how many documents it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task():
            index, weights = sent.value
            at = {i: k for k, i in enumerate(index.ids)}
            for batch in batches:
                votes = [index.vote(index.search(*unit(own, counts, weights), neighbours, at[i])) if len(own) else None for i, (own, counts) in zip(batch.column(0).to_pylist(), _lists(batch, 2), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(votes, pa.float64())], ["label", "vote"])

    dealt = of_examples.repartition(16, of_examples.columns[0])
    rows = sorted((r["vote"], r["label"]) for r in dealt.mapInArrow(run, "label int, vote double").collect() if r["vote"] is not None)
    labels = np.array([x for _, x in rows], int)
    return np.array([v for v, _ in rows]), labels.astype(float), np.array([stands[x] for x in labels.tolist()])


def toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_terms: int = MAX_TERMS, neighbours: int = NEIGHBOURS, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted, evidence) for each row; evidence: (example, cosine, label) of the nearest.

    Learns from labelled rows whose crc32(id) mod 5 is not 0, at most max_toxic and max_clean of them. Terms are all
    words that LEAST_EXAMPLES or more of these hold (at most max_terms, the most frequent); a term weighs its inverse
    document frequency, counted over all documents, times its relevance among the examples (term_weights). Of ids
    that several rows of docs share, the smallest text is the example. Examples of a class stand for its true share.
    The curve that turns votes into scores is fitted on each example's vote without itself.

    A score is a function of the whole text alone. Every text with a term is scored by its neighbours, toxic or
    clean; texts without, empty and null ones among them, get the share of toxic rows among such examples. Without
    examples of both classes every score is the share of toxic examples, or 0. Repeated rows score alike; rows
    without an id are scored, not held out; empty tables give empty results; other columns are left out.

    One pass over the texts, whose terms are written to the shared folder, and two over these. The index is bounded
    by the parameters and broadcast; documents are scored where they are read, without a shuffle.
    """
    spark = python_ready(docs)
    with saved(spark) as save:
        sample = save(examples(labels, label_col, (max_clean, max_toxic), id_col), "toxicity-sample")
        given = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
        told = save(given.join(F.broadcast(sample), id_col).groupBy(id_col, "_label").agg(F.min("_text").alias("_text")), "toxicity-examples")
        seen = words_of(told).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("_label").alias("toxic")).filter(F.col("n") >= LEAST_EXAMPLES)
        vocabulary = sorted((r["term"], r["n"], r["toxic"]) for r in seen.orderBy(F.desc("n"), "term").limit(max_terms).collect())
        terms, toxic = [t for t, _, _ in vocabulary], np.array([x for _, _, x in vocabulary], float)
        clean = np.array([n for _, n, _ in vocabulary], float) - toxic
        counted = save(term_counts(given, [id_col], terms), "toxicity-terms", keep=True)
        weights = term_weights(document_frequencies(counted, len(terms)), counted.count(), toxic, clean)
        # at most max_toxic + max_clean rows, as numbers
        of_examples = save(term_counts(told, [id_col, "_label"], terms), "toxicity-vectors")
        vectors = sorted(((r[id_col], r["_label"], *lists) for batch in of_examples.toArrow().combine_chunks().to_batches() for r, lists in zip(batch.select([0, 1]).to_pylist(), _lists(batch, 2), strict=True)), key=lambda r: str(r[0]))
        all_of = labels.filter(~held_out(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(F.col(label_col).cast("int").alias("label")).count()
        natural, drawn = dict(all_of.collect()), Counter(r[1] for r in vectors)
        stands = {k: natural.get(k, 0) / drawn[k] for k in drawn}
        blank = [r for r in vectors if not len(r[2])] if len(drawn) > 1 else []
        total = sum(stands[r[1]] for r in vectors)
        base = sum(stands[r[1]] * r[1] for r in blank) / (sum(stands[r[1]] for r in blank) + 1) if blank else sum(stands[r[1]] * r[1] for r in vectors) / total if vectors else 0.0
        vectors = [(r[0], r[1], *unit(r[2], r[3], weights)) for r in vectors if len(r[2])] if len(drawn) > 1 else []
        index = BlockMaxIndex([r[2:] for r in vectors], [r[1] for r in vectors], [r[0] for r in vectors], [stands[r[1]] for r in vectors], len(terms))
        sent = spark.sparkContext.broadcast((index, weights))
        slope, shift = (4.0, -2.0)
        if vectors:
            slope, shift = fit_logistic(*own_votes(of_examples, sent, neighbours, stands), (4.0, -2.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task():
            index, weights = sent.value
            for batch in batches:
                ids = pa.array(index.ids, batch.schema.field(0).type)
                scores, near, cosines, ends = [], [], [], [0]
                for own, counts in _lists(batch, 1):
                    found = index.search(*unit(own, counts, weights), neighbours) if len(own) and index.blocks else []
                    scores.append(float(1 / (1 + np.exp(-np.clip(slope * index.vote(found) + shift, -30, 30)))) if found else base)
                    near += [i for _, i in found]
                    cosines += [round(s, 6) for s, _ in found]
                    ends.append(len(near))
                at = np.array(near, np.int64)
                struct = pa.StructArray.from_arrays([ids.take(pa.array(at)), pa.array(cosines, pa.float64()), pa.array(index.labels[at].astype(np.int32))], ["example", "cosine", "label"])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], [id_col, "score", "evidence"])

    evidence = T.ArrayType(T.StructType().add("example", docs.schema[id_col].dataType).add("cosine", T.DoubleType()).add("label", T.IntegerType()))
    scored = counted.mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)]))
    return scored.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
