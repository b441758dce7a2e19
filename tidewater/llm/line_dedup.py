"""Line dedup: explode the lines' keys, hash them, count documents per hash, drop, and reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import hot_join, saved

#: The white space that is stripped, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_lines, n_dropped, text): the documents without lines that other documents hold too.

    Keys of at least min_chars code points found in min_docs documents or more stay only in the document with the
    smallest id; a document keeps all its lines of a key that it may keep. Lines with a shorter key always stay.
    A null or empty text is one empty line. Rows that share an id count as one document, and each is returned; rows
    without an id are never counted or changed. Other columns are left out. Empty tables give empty results.

    Lines are exploded with their positions, and keys hashed to 128 bits: at 10^13 different lines, two alike are less
    likely than 10^-12. Only hashes, ids and positions are shuffled to find what goes; a hash that many documents hold
    is counted before the shuffle and sliced in the join. Texts are then joined to the positions that they lose, by id
    and a hash of the text, and reassembled of the others.
    """
    with saved(docs.sparkSession) as save:
        docs = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_row", F.xxhash64("_text"))
        lines = docs.filter("_id is not null").select("_id", "_row", F.posexplode(F.split("_text", "\n", -1)).alias("_at", "_line"))
        long = lines.select("_id", "_row", "_at", line_key(F.col("_line")).alias("_key")).filter(F.length("_key") >= min_chars)
        held = save(long.select("_id", "_row", "_at", F.unhex(F.md5("_key")).alias("_h")), "lines-held")
        per_doc = held.groupBy("_h", "_id").agg(F.count(F.lit(1)).alias("_n"))
        common = per_doc.groupBy("_h").agg(F.count(F.lit(1)).alias("_docs"), F.min("_id").alias("_first"), F.sum("_n").alias("_n")).filter(F.col("_docs") >= min_docs)
        common = save(common.drop("_docs"), "lines-common")
        lost = hot_join(held, common, ["_h"], "_n", held.count(), F.xxhash64("_id", "_row", "_at")).filter("_id <> _first")
        lost = save(lost.groupBy("_id", "_row").agg(F.collect_set("_at").alias("_lost")), "lines-lost", keep=True)
    out = docs.join(lost, ["_id", "_row"], "left").select("_id", "_lost", F.split("_text", "\n", -1).alias("_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_lost")
    text = F.array_join(F.when(F.col("_lost").isNull(), F.col("_lines")).otherwise(F.transform(kept, lambda k: F.get("_lines", k))), "\n")
    return out.select(F.col("_id").alias(id_col), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"), text.alias(text_col))
