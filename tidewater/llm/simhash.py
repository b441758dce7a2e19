"""SimHash near-dedup: fingerprints, their segments' bit counts, a grid range-join on these, and exact checks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import hot_join, python_ready, python_task, saved, slices, without
from tidewater.llm.components import connected_components

WORDS, SEED, BITS = 3, 42, 2
#: Up to so many fingerprints 8 segments tell cells apart well enough; beyond, 16. The links found are the same.
FEW = 1 << 20


def majority(hashes: np.ndarray) -> int:
    """64 bits, as a signed number: a bit is 1 if it is set in over half of the hashes; without any, zero."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(np.int64)[0])


def fingerprint(text: str | None, n_words: int = WORDS, seed: int = SEED) -> int:
    r"""64 bits, as a signed number: a bit is 1 if it is set in over half of the shingles' XXH64.

    A-Z in lower case; words are [^\x20\x09-\x0D]+; shingles with repeats, space-joined; fewer words: the whole
    sequence; none, or a null text: zero.
    """
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only these characters split
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(n_words)), strict=False)) if len(words) >= n_words else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(x, seed) for x in shingles], np.uint64))


def fingerprints(docs: DataFrame, n_words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, fp): row is a hash of the text, which tells rows apart that share an id. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task():
            for batch in slices(batches):
                found = pa.array([fingerprint(x.as_py(), n_words, seed) for x in batch.column(2)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["id", "row", "fp"])

    python_ready(docs)
    schema = T.StructType().add("id", docs.schema[id_col].dataType).add("row", T.LongType()).add("fp", T.LongType())
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def segment_counts(fp: Column, segments: int) -> Column:
    """The bits set in each of 8 or 16 segments, side by side in one number: 8 or 4 bits for each count."""

    def fold(x: Column, by: int, mask: int) -> Column:
        return x.bitwiseAND(F.lit(mask)) + F.shiftrightunsigned(x, by).bitwiseAND(F.lit(mask))

    low, high = (x.bitwiseAND(F.lit(0x5555555555555555)) for x in (fp, F.shiftrightunsigned(fp, 1)))
    pairs = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # low + high would overflow
    nibbles = fold(pairs, 2, 0x3333333333333333)
    return nibbles if segments == 16 else fold(nibbles, 4, 0x0F0F0F0F0F0F0F0F)


def steps(segments: int, most: int) -> list[int]:
    """Differences of two cells at a Manhattan distance of at most `most`, one of each pair of opposites, and zero."""
    width, found = 64 // segments, set()
    for n in range(most + 1):
        for where in combinations(range(segments), n):
            for by in product([x for x in range(-most, most + 1) if x], repeat=n):
                if sum(map(abs, by)) <= most:
                    found.add(sum(d << (width * k) for k, d in zip(where, by, strict=True)))
    return sorted(x for x in found if 0 <= x < 1 << 63)


def close_pairs(points: DataFrame, most: int = BITS, few: int = FEW) -> DataFrame:
    """(u, v) for the different fingerprints of column fp that differ in at most `most` bits.

    Two fingerprints differ in at least as many bits as their segment counts are apart in Manhattan distance. So
    each is placed in the cell of its counts and looks in the cells at most that far; half of these are enough, as
    the other half look back. What meets is checked exactly, in the join's own condition. Neither side is broadcast:
    Spark takes the looks, 73 or 273 rows for each fingerprint, for no larger than the fingerprints.
    """
    segments = 8 if points.count() <= few else 16
    cell = segment_counts(F.col("fp"), segments)
    home = points.select(cell.alias("_cell"), F.col("fp").alias("v"))
    looks = points.select("fp", cell.alias("_own")).select(F.col("fp").alias("u"), "_own", F.explode(F.lit(steps(segments, most))).alias("_step"))
    looks = looks.select("u", (F.col("_step") == 0).alias("_here"), F.try_add("_own", "_step").alias("_cell"))
    near = (looks["_cell"] == home["_cell"]) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most) & (~F.col("_here") | (F.col("u") < F.col("v")))
    return looks.hint("merge").join(home, near).select("u", "v")


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """(fp, _first, _n): each fp of prints once, with its smallest id and number of rows."""
    return prints.groupBy("fp").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n"))


def component_rows(prints: DataFrame, classes: DataFrame, links: DataFrame, save) -> DataFrame:
    """prints (id, row, fp) with component_id, the smallest id that the links (u, v) between fps join to the row's fp."""
    grouped = connected_components(links).join(classes, F.col("node") == classes["fp"])
    firsts = grouped.groupBy("component").agg(F.min("_first").alias("_least"))
    linked = grouped.join(firsts, "component").select(F.col("node").alias("fp"), "_least")
    whole = save(classes.join(linked, "fp", "left").select("fp", "_n", F.coalesce("_least", "_first").alias("component_id")), "simhash-groups", keep=True)
    return hot_join(prints, whole, ["fp"], "_n", prints.count(), F.xxhash64("id", "row"))


def near_duplicates(docs: DataFrame, most: int = BITS, n_words: int = WORDS, seed: int = SEED, few: int = FEW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id, row) for each row: documents that a chain of close fingerprints joins.

    component_id is the smallest id reachable, the row's own included; nulls are passed over, and a component without
    any id has null. Texts without words have fingerprint zero, which links like any other. Repeated rows get equal
    results. Empty tables give empty results; other columns are left out.

    Equal fingerprints are merged first, so the pairs are between different ones; a fingerprint that many documents
    have is spread when results go back to the rows.
    """
    with saved(docs.sparkSession) as save:
        prints = save(fingerprints(docs, n_words, seed, id_col, text_col), "simhash-prints", keep=True)
        classes = save(fingerprint_classes(prints), "simhash-classes")
        links = save(close_pairs(classes, most, few), "simhash-links")
        out = component_rows(prints, classes, links, save)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "row")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with their columns; rows without an id stay."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter(F.col("component_id") != F.col(id_col))
    return without(docs, gone.select(F.col(id_col).alias("_gone"), "row"), id_col, text_col, "simhash-gone")
