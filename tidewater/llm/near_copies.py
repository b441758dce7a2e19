"""Near copies by exact similarity: SimHash's grid join, then minimum hashes in bands, and all shingles for what meets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import hot_join, python_ready, python_task, saved, slices, without
from tidewater.llm.components import connected_components
from tidewater.llm.simhash import BITS, close_pairs, component_rows, fingerprint_classes, majority

#: Words of a shingle, and the least Jaccard similarity of two shingle sets that links them.
WORDS, SIMILARITY = 5, 0.8
#: Bands, and minimum hashes in each. Sets of similarity s share no band with chance (1 - s**ROWS) ** BANDS: 0.0001 at 0.8.
BANDS, ROWS = 30, 6
#: Fingerprints of whole shingle sets at that similarity are over so many bits apart with a chance of 0.0003; of unlike ones, up to it with 0.002.
WIDE_BITS = 20
#: Bands of the first round, in which each bucket's first member meets the others; in the next all bands do so, then
#: so many further members, and from there on sixteen times as many in each round.
FIRST_BANDS, LEADERS = 4, 8

_random = np.random.default_rng(5)
_BY, _PLUS = (_random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_BY |= np.uint64(1)


def shingle_set(text: str | None, n_words: int = WORDS) -> np.ndarray:
    """The different shingles' XXH64 in order; words as in simhash.fingerprint. Fewer words: the whole sequence; none: empty."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(n_words)), strict=False)) if len(words) >= n_words else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(x) for x in shingles], np.uint64))


def word_mark(text: str | None) -> int:
    """SimHash of the different words: an edit changes one of them, but five shingles, so marks of near copies are close."""
    return majority(np.array([xxhash.xxh64_intdigest(x) for x in set((text or "").encode().lower().split())], np.uint64))


def _set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def band_keys(shingles: np.ndarray) -> list[int]:
    """One number for each band; none for a set without shingles."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 1 << 10):
        np.minimum(least, (shingles[k : k + (1 << 10)] * _BY + _PLUS).min(1), out=least)
    return [xxhash.xxh64_intdigest(part.tobytes(), band) - (1 << 63) for band, part in enumerate(least.reshape(BANDS, ROWS))]


def sketches(docs: DataFrame, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, fp, n, mark, wide, bands): fp tells shingle sets apart, n is their size; SimHash of words and of shingles. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task():
            for batch in slices(batches):
                sets = [shingle_set(x.as_py(), n_words) for x in batch.column(2)]
                marks = [word_mark(x.as_py()) for x in batch.column(2)]
                found = [pa.array(map(_set_id, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(marks, pa.int64()), pa.array(map(majority, sets), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["id", "row", "fp", "n", "mark", "wide", "bands"])

    python_ready(docs)
    schema = T.StructType().add("id", docs.schema[id_col].dataType).add("row", T.LongType()).add("fp", T.LongType()).add("n", T.IntegerType()).add("mark", T.LongType()).add("wide", T.LongType()).add("bands", T.ArrayType(T.LongType()))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def shingles_of(docs: DataFrame, wanted: DataFrame, n_words: int, text_col: str) -> DataFrame:
    """(fp, shingles, short) for the sets of wanted (fp, row), each read from one text with that row hash; short: 32 bits of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task():
            for batch in slices(batches):
                sets = [shingle_set(x.as_py(), n_words) for x in batch.column(1)]
                lists = [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([x.astype(np.uint32).view(np.int32) for x in sets], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["fp", "shingles", "short"])

    texts = docs.select(F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")).join(wanted, "row").select("fp", "text")
    # copies of a text are rare here, and what is left of them goes after the shingles are made
    return texts.mapInArrow(run, "fp long, shingles array<long>, short array<int>").dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of at least `least`; a set in many pairs is spread."""
    degrees = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("_degree"))
    left = degrees.join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("_a")), "u")
    met = pairs.join(sets.select(F.col("fp").alias("v"), F.col("shingles").alias("_b")), "v")
    met = hot_join(met, left, ["u"], "_degree", pairs.count(), F.col("v"))
    both = F.size(F.array_intersect("_a", "_b"))
    return met.filter(both / (F.size("_a") + F.size("_b") - both) >= F.lit(least)).select("u", "v")


def grid_pairs(classes: DataFrame, most: int, least: float, save) -> DataFrame:
    """(u, v): sets of classes (fp, n, mark, wide) whose marks differ in at most `most` bits, and whose sizes and shingles' fingerprints allow the similarity.

    Of sets with one mark the first meets the others, and the firsts of close marks meet, so a mark's sets never
    meet each other in all pairs; what else is similar among them meets in the bands.
    """
    firsts = save(classes.groupBy("mark").agg(F.min(F.struct("fp", "n", "wide")).alias("_first"), F.count(F.lit(1)).alias("_n")), "near-marks")
    close = close_pairs(firsts.select(F.col("mark").alias("fp")), most)
    left, right = (firsts.select(F.col("mark").alias(x), F.col("_first").alias(f"_{x}")) for x in "uv")
    across = close.join(left, "u").join(right, "v").select("_u", "_v")
    within = hot_join(classes.select("mark", "fp", "n", "wide"), firsts.filter("_n > 1"), ["mark"], "_n", classes.count(), F.col("fp"))
    within = within.filter(F.col("fp") != F.col("_first.fp")).select(F.col("_first").alias("_u"), F.struct("fp", "n", "wide").alias("_v"))
    sizes = [F.col(f"_{x}.n") for x in "uv"]
    alike = (F.least(*sizes) >= F.lit(least) * F.greatest(*sizes) - 1e-6) & (F.bit_count(F.col("_u.wide").bitwiseXOR(F.col("_v.wide"))) <= WIDE_BITS)
    return across.union(within).filter(alike).select(F.col("_u.fp").alias("u"), F.col("_v.fp").alias("v"))


def unsettled(ranked: DataFrame, links: DataFrame, save) -> DataFrame:
    """The buckets of ranked whose members the links do not all join yet, with each member's component."""
    now = ranked.join(connected_components(links).select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    open_ = now.groupBy("_at", "band").agg((F.min("component") != F.max("component")).alias("_open")).filter("_open").select("_at", "band")
    return save(now.join(open_, ["_at", "band"]), "near-rest")


def rounds() -> Iterator[tuple[int, int, int]]:
    """(bands, first, last): the ranks of the members that meet all later ones in the first `bands` bands, round by round."""
    yield FIRST_BANDS, 1, 1
    yield BANDS, 1, 1
    first, n = 2, LEADERS
    while True:
        yield BANDS, first, first + n - 1
        first, n = first + n, 16 * n


def similar_links(docs: DataFrame, classes: DataFrame, n_words: int, least: float, text_col: str, save, most: int = BITS) -> DataFrame:
    """(u, v): links that join the sets of classes (fp, row, n, mark, wide, bands) as all their pairs of that similarity in the grid or a band would.

    SimHash comes first: what meets in the grid of marks and passes the check with all shingles is linked. Sets of that
    similarity can be more bits apart than a grid can look, so the bands find the rest, where the links have not joined a
    bucket's members yet. In each round some members of a band's bucket meet its later ones, if they are not of one
    component yet. A bucket whose later members are not all of one component by then goes on with more of them, until
    all have met: pairs are left out only within a component, never for their number. What meets is checked in the
    join's own condition with 32 bits of every shingle and some slack for what these confuse, and what passes with all
    bits, so nearly all that leaves the join is links; a frequent bucket is cut by Spark's skew handling.
    """
    met = save(grid_pairs(classes, most, least, save), "near-met")
    member = classes.select(F.posexplode("bands").alias("_at", "band"), "fp", "n")
    inside = Window.partitionBy("_at", "band").orderBy("fp")
    ranked = member.select("*", F.row_number().over(inside).alias("rank"), F.lead("fp").over(inside).alias("_next"))
    ranked = save(ranked.filter("rank > 1 or _next is not null").drop("_next"), "near-bands")
    wanted = ranked.select("fp").union(met.select("u")).union(met.select("v")).distinct().join(classes.select("fp", "row"), "fp")
    sets = save(shingles_of(docs, wanted, n_words, text_col), "near-sets")
    short = sets.select("fp", "short")
    links = save(verified(met, sets, least), "near-links")
    now = unsettled(ranked, links, save)
    for bands, first, last in rounds():
        if now.isEmpty():
            break
        lead = now.filter(F.col("rank").between(first, last)).join(short, "fp").select("_at", "band", F.col("fp").alias("u"), F.col("n").alias("_n"), F.col("rank").alias("_rank"), F.col("component").alias("_component"), F.col("short").alias("_short"))
        rest = now.filter((F.col("rank") > first) & (F.col("_at") < bands)).join(short, "fp")
        meets = (F.col("rank") > F.col("_rank")) & (F.col("component") != F.col("_component")) & (F.least("n", "_n") >= F.lit(least) * F.greatest("n", "_n") - 1e-6)
        # both / (n + _n - both) >= least; two shingles of a set that share their 32 bits count as one
        near = F.size(F.array_intersect("short", "_short")) >= (F.col("n") + F.col("_n")) * F.lit(least / (1 + least) - 1e-4) - 2
        pairs = save(rest.join(lead, ["_at", "band"]).filter(meets & near).select("u", F.col("fp").alias("v")).distinct(), "near-pairs")
        links = links.union(save(verified(pairs, sets, least), "near-links"))
        if bands == BANDS:
            ranked = ranked.filter(F.col("rank") > last)
            if ranked.isEmpty():
                break
        now = unsettled(ranked, links, save)
    return links


def near_copies(docs: DataFrame, n_words: int = WORDS, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id, row) for each row: documents that a chain of texts joins, each similar to the next.

    Two texts are similar if the Jaccard similarity of their sets of n_words shingles is at least `least`; texts without
    words are similar to each other. component_id is the smallest id reachable, the row's own included; nulls are passed
    over. Candidates have SimHash fingerprints a few bits apart, by the grid join of op7, or share a band; each is
    checked with all shingles, so what is linked is similar without exception.
    """
    with saved(docs.sparkSession) as save:
        drawn = save(sketches(docs, n_words, id_col, text_col), "near-sketches")
        classes = drawn.groupBy("fp").agg(F.min("row").alias("row"), *(F.first(x).alias(x) for x in ("n", "mark", "wide", "bands")))
        classes = save(classes, "near-classes")
        links = save(similar_links(docs, classes, n_words, least, text_col, save), "near-all-links")
        prints = save(drawn.select("id", "row", "fp"), "near-prints", keep=True)
        return component_rows(prints, fingerprint_classes(prints), links, save).select(F.col("id").alias(id_col), "component_id", "row")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with their columns; rows without an id stay."""
    gone = near_copies(docs, id_col=id_col, text_col=text_col, **options).filter(F.col("component_id") != F.col(id_col))
    return without(docs, gone.select(F.col(id_col).alias("_gone"), "row"), id_col, text_col, "near-gone")
