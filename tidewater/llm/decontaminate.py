"""Benchmark decontamination by spaced-seed hashing: masks ignore fixed token positions, hits are verified around."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import hot_join, saved, without
from tidewater.llm.line_dedup import LOWER, UPPER

#: Fixed masks: 1 for a token that counts, 0 for one that may differ.
MASKS = ("1110111", "11011011", "101101101")
#: Share of an item's tokens that must agree where it lies in the document.
OVERLAP = 0.5
#: Bytes of benchmark hashes up to which they are broadcast; beyond, both sides are shuffled.
SMALL = 64 << 20
#: Neighbouring diagonals of a document and an item that are verified in one row.
NEAR = 64


def tokens(text: Column) -> Column:
    r"""Words [^\x20\x09-\x0D]+ with A-Z in lower case."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def hashed_tokens(text: Column) -> Column:
    """The tokens as 64-bit hashes, which are compared in their place."""
    return F.transform(tokens(text), lambda x: F.xxhash64(x))


def shifted(words: Column, span: int) -> Column:
    """A struct (w0, w1, ...) of span tokens for each start, with nulls past the end.

    So what is computed of them is a plain expression over rows, compiled into the stage, and no lambda over arrays.
    """
    return F.arrays_zip(*(F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))).alias(f"w{k}") for k in range(span)))


def seeds(rows: DataFrame, keep: Sequence[str], words: str, masks: Sequence[str]) -> DataFrame:
    """(*keep, at, _seed): the hashed seeds of each row's tokens; at counts from 0."""
    span = max(map(len, masks))
    starts = rows.select(*keep, F.posexplode(shifted(F.col(words), span)).alias("at", "_w"))
    hashed = []
    for n, mask in enumerate(masks):
        kept = [F.col(f"_w.w{k}") for k in range(span) if k < len(mask) and mask[k] == "1"]
        hashed.append(F.when(F.col(f"_w.w{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(n), *kept)))
    return starts.select(*keep, "at", F.explode(F.array(*hashed)).alias("_seed")).filter("_seed is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, masks: Sequence[str] = MASKS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, row, item_id, start, matched, n_tokens, overlap): where an item lies in a document, its best place each.

    An item is found where at least the share `overlap` of its tokens equal the document's at the same distance, in
    place, so any may be substituted as long as one mask finds the tokens that it keeps; items at a document's edge
    may stick out, which counts as different. Items shorter than the shortest mask are found when all their tokens
    stand in a row. row is a hash of the text, which tells rows apart that share an id. Null and empty texts, and
    items without tokens, are never found; repeated items are found each; empty tables give empty results.

    The benchmark's hashes are broadcast while they are few (their number is counted), else joined by shuffle, where
    Spark's skew handling cuts what a frequent seed brings. Hits are merged to one row per document, item and diagonal
    before they are shuffled, then to one for each NEAR neighbouring diagonals, so no row grows with a document's hits.
    Only texts of documents with hits are read again. A passage that very many documents hold gives each of them a
    row, and no pairs of documents.
    """
    span = min(map(len, masks))
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("row", F.xxhash64("_text"))
    with saved(docs.sparkSession) as save:
        items = benchmark.select(F.col(item_col).alias("item_id"), hashed_tokens(F.col(item_text_col)).alias("_item")).filter(F.size("_item") > 0)
        items = save(items, "decon-items", keep=True)
        long = seeds(items, ["item_id"], "_item", masks).select("item_id", F.col("at").alias("_item_at"), "_seed")
        # a short item is one seed: its tokens, all of which count, at each length below the shortest mask
        short = items.filter(F.size("_item") < span).select("item_id", F.lit(0).alias("_item_at"), F.xxhash64(F.lit(-1), "_item").alias("_seed"), F.size("_item").alias("_length"))
        wanted = save(long.union(short.select("item_id", "_item_at", "_seed")), "decon-seeds")
        lengths = sorted(r[0] for r in short.select("_length").distinct().collect())
        words = docs.select("_id", "row", hashed_tokens(F.col("_text")).alias("_words"))
        found = seeds(words, ["_id", "row"], "_words", masks)
        for n in lengths:
            run = words.select("_id", "row", F.posexplode(shifted(F.col("_words"), n)).alias("at", "_w"))
            found = found.union(run.filter(f"_w.w{n - 1} is not null").select("_id", "row", "at", F.xxhash64(F.lit(-1), F.array(*(F.col(f"_w.w{k}") for k in range(n))))))
        few = wanted.count() * 64 <= SMALL
        hits = found.join(F.broadcast(wanted) if few else wanted, "_seed").select("_id", "row", "item_id", (F.col("at") - F.col("_item_at")).alias("start")).distinct()
        hits = hits.groupBy("_id", "row", "item_id", F.floor(F.col("start") / NEAR).alias("_part")).agg(F.collect_list("start").alias("_starts")).drop("_part")
        hits = save(hits, "decon-hits", keep=True)
        n_hits, n_starts = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_starts")), F.lit(0))).first()
        # the texts of documents with hits, and the items, beside each hit
        own = hits.withColumnsRenamed({"_id": "_own", "row": "_row"})
        read = docs.join(F.broadcast(own) if 64 * n_hits + 8 * n_starts <= SMALL else own, F.col("_id").eqNullSafe(F.col("_own")) & F.col("row").eqNullSafe(F.col("_row")))
        read = read.select("_id", "row", "item_id", "_starts", hashed_tokens(F.col("_text")).alias("_words"))
        if items.agg(F.coalesce(F.sum(F.size("_item") + 8), F.lit(0))).first()[0] * 8 <= SMALL:
            beside = read.join(F.broadcast(items), "item_id")
        else:
            per_item = hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
            beside = hot_join(read, save(items.join(per_item, "item_id"), "decon-known", keep=True), ["item_id"], "_n", n_hits, F.xxhash64("_id", "row", "_starts"))
    each = beside.select("_id", "row", "item_id", F.size("_item").alias("n_tokens"), F.inline(F.transform("_starts", lambda s: F.struct(s.alias("start"), _agreeing(F.col("_words"), F.col("_item"), s).alias("matched")))))
    each = each.withColumn("overlap", F.col("matched") / F.col("n_tokens")).filter(F.col("overlap") >= F.when(F.col("n_tokens") < span, F.lit(1.0)).otherwise(F.lit(overlap)))
    best = each.groupBy("_id", "row", "item_id").agg(F.max(F.struct("matched", (-F.col("start")).alias("_start"), "n_tokens", "overlap")).alias("_b"))
    return best.select(F.col("_id").alias(id_col), "row", "item_id", (-F.col("_b._start")).alias("start"), "_b.matched", "_b.n_tokens", "_b.overlap")


def _agreeing(words: Column, item: Column, start: Column) -> Column:
    """How many of the item's tokens equal the document's where the item starts at `start`, which may be negative."""
    part = F.slice(words, F.greatest(start, F.lit(0)) + 1, F.size(item))
    own = F.slice(item, F.greatest(-start, F.lit(0)) + 1, F.size(item))
    return F.size(F.filter(F.zip_with(part, own, lambda a, b: a == b), lambda same: same))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns."""
    gone = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias("_gone"), "row")
    return without(docs, gone, id_col, text_col, "decon-gone")
