"""Exact dedup by an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.llm.common import contents, forget, hot_join, names_in, new_path, publish, python_ready, python_task, saved, slices, without

#: Keys in a bucket before it is split. More where that would make over MOST_BUCKETS, as each takes some bytes at the driver.
CAPACITY, MOST_BUCKETS = 4096, 1 << 21
#: Tasks that buckets are dealt to, at most; each owns the buckets of a range of keys.
OWNERS = 20_000
#: Bytes of text that a task holds while it combines copies, and rows of a batch that it gives on.
HELD, ROWS = 16 << 20, 512


def normalised(text: str | None) -> bytes:
    r"""Each run of [\x20\x09-\x0D] as one space, in UTF-8; null is empty."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at these characters and no others
    if not words:
        return b" " if raw else b""
    return b" " * raw[:1].isspace() + b" ".join(words) + b" " * raw[-1:].isspace()


def text_key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


class Directory:
    """2**depth slots, each with its bucket; a bucket of local depth d owns the slots, and so the keys, with its d leading bits."""

    def __init__(self) -> None:
        self.depth, self.slots, self.owns = 0, np.zeros(1, np.int32), [(0, 0)]

    def split(self, bucket: int) -> int:
        """Splits a bucket by its next bit, and doubles the directory if the bucket owns one slot only."""
        prefix, local = self.owns[bucket]
        if local == self.depth:
            self.slots = np.repeat(self.slots, 2)
            self.depth += 1
        new = len(self.owns)
        self.owns[bucket] = 2 * prefix, local + 1
        self.owns.append((2 * prefix + 1, local + 1))
        width = 1 << (self.depth - local - 1)
        self.slots[(2 * prefix + 1) * width : (2 * prefix + 2) * width] = new
        return new

    def grow(self, sums: np.ndarray, bits: int, capacity: int) -> Directory:
        """Splits every bucket that holds over capacity keys, again and again; sums: keys before each prefix of `bits` bits."""
        todo = list(range(len(self.owns)))
        while todo:
            prefix, local = self.owns[bucket := todo.pop()]
            width = 1 << max(bits - local, 0)
            if local < bits and sums[(prefix + 1) * width] - sums[prefix * width] > capacity:
                todo += [bucket, self.split(bucket)]
        return self

    def owners(self) -> np.ndarray:
        """By bucket, its rank among all in the order of their keys."""
        first = np.array([prefix << (self.depth - local) for prefix, local in self.owns])
        return np.argsort(np.argsort(first))

    def json(self) -> str:
        return json.dumps({"depth": self.depth, "buckets": self.owns})

    @classmethod
    def of_json(cls, text: str) -> Directory:
        self, spec = cls(), json.loads(text)
        self.depth, self.owns = spec["depth"], [tuple(x) for x in spec["buckets"]]
        self.slots = np.zeros(1 << self.depth, np.int32)
        for bucket, (prefix, local) in enumerate(self.owns):
            width = 1 << (self.depth - local)
            self.slots[prefix * width : (prefix + 1) * width] = bucket
        return self


def leading(key: Column, bits: int) -> Column:
    """The first bits of a signed key whose smallest value stands for 0."""
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0)


def _placed(sent, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds columns owner and bucket to rows whose column `at` is the key; sent: the directory's depth, slots, ranks and number of owners."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task():
            depth, slots, ranks, owners = sent.value
            for batch in batches:
                key = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
                bucket = slots[(key >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(key), np.int64)]
                owner = (ranks[bucket].astype(np.int64) * owners // len(ranks)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(bucket), *batch.columns], ["owner", "bucket", *batch.schema.names])

    return place


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with python_task():
        for batch in slices(batches):
            texts = [normalised(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(text_key, texts), pa.int64()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())], ["_id", "_row", "_key", "_sha"])


def least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a task, copies become one row with the smallest id and their number."""
    with python_task():
        held: dict[bytes, list] = {}
        size, kind = 0, None

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            for k in range(0, len(rows), ROWS):
                some = rows[k : k + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([text_key(t) for t, _ in some], pa.int64()), pa.array([t for t, _ in some], pa.binary()), pa.array([v[0] for _, v in some], kind), pa.array([v[1] for _, v in some], pa.int64())], ["_key", "_text", "_first", "_n"])

        for batch in slices(batches):
            kind = batch.schema.field(0).type
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = normalised(x.as_py())
                if text in held:
                    own = held[text]
                    own[0], own[1] = least(own[0], i), own[1] + 1
                else:
                    held[text] = [i, 1]
                    size += len(text)
                    if size > HELD:
                        yield from out()
                        held.clear()
                        size = 0
        if held:
            yield from out()


def _chained(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows (bucket, key, text, first, n) in the order of their keys: those of one key form a chain of different texts."""
    last, chain = None, []

    def ended() -> Iterator[tuple]:
        for link, (text, first, n) in enumerate(chain):
            yield (*last, link, hashlib.sha256(text).digest(), first, n, text)

    for bucket, key, text, first, n in rows:
        if (bucket, key) != last:
            yield from ended()
            last, chain = (bucket, key), []
        for own in chain:
            if own[0] == text:  # compares the bytes
                own[1], own[2] = least(own[1], first), own[2] + n
                break
        else:
            chain.append([text, first, n])
    yield from ended()


def _owner(kind: pa.DataType, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), kind, pa.int64(), pa.binary()][: 7 if texts else 6]
    names = ["bucket", "_key", "link", "_sha", "keep_id", "group_size", "_bytes"][: 7 if texts else 6]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[: len(types)], types, strict=True)], names)

        with python_task():
            held: list[tuple] = []
            size = 0
            for row in _chained(r for batch in slices(batches) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                held.append(row)
                size += len(row[-1]) if texts else 0
                if len(held) == 4 * ROWS or size > HELD:
                    yield out(held)
                    held, size = [], 0
            if held:
                yield out(held)

    return own


class HashIndex:
    """An extendible-hash index of texts under a path: a directory file for each version, and the chains of its buckets.

    Chains are Parquet files, one for each owner of a range of keys, sorted by bucket and key. Files never change: adding
    documents writes the chains anew beside the old ones, and a version becomes real when its directory file appears,
    which fails if another writer was first.
    """

    def __init__(self, spark: SparkSession, path: str, capacity: int = CAPACITY):
        self.spark, self.path, self.capacity = spark, path.rstrip("/"), capacity

    def version(self) -> int:
        """The latest version; 0 before documents were added."""
        return max((int(x[1:-5]) for x in names_in(self.spark, f"{self.path}/_directory") if x.startswith("v")), default=0)

    def directory(self) -> Directory:
        version = self.version()
        return Directory.of_json(contents(self.spark, f"{self.path}/_directory/v{version:06d}.json")) if version else Directory()

    def chains(self) -> DataFrame:
        """(bucket, _key, link, _sha, keep_id, group_size[, _bytes]): each different text once, in the chain of its key."""
        return self.spark.read.parquet(f"{self.path}/chains-{self.version():06d}")

    def add(self, docs: DataFrame, postings: DataFrame, texts: bool = True) -> int:
        """Adds documents (_id, _text) whose keys are in postings; the version then. Without texts no more can be added later."""
        old, id_type, total = self.version(), docs.schema["_id"].dataType, 0
        keys = postings.select("_key")
        if old:
            known = self.chains().select("_key", F.col("_bytes").alias("_text"), F.col("keep_id").alias("_first"), F.col("group_size").alias("_n"))
            keys, total = keys.union(known.select("_key")), known.count()
        total += postings.count()
        capacity = max(self.capacity, total // MOST_BUCKETS)
        directory = self.directory()
        bits = max(4, ceil(log2(max(1, total / capacity))) + 3, directory.depth)
        loads = keys.distinct().groupBy(leading(F.col("_key"), bits).cast("long").alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # some 16 rows a bucket
        counts = np.zeros(1 << bits, np.int64)
        counts[loads.column("slot").to_numpy()] = loads.column("n").to_numpy()
        directory.grow(np.concatenate([[0], np.cumsum(counts)]), bits, capacity)
        n = len(directory.owns)
        owners = min(n, OWNERS)
        sent = self.spark.sparkContext.broadcast((directory.depth, directory.slots, directory.owners(), owners))  # some 12 bytes a bucket
        rows = T.StructType().add("_key", T.LongType()).add("_text", T.BinaryType()).add("_first", id_type).add("_n", T.LongType())
        combined = docs.mapInArrow(_combined, rows)
        if old:
            combined = combined.union(known)
        placed = T.StructType().add("owner", T.IntegerType()).add("bucket", T.IntegerType())
        placed = combined.mapInArrow(_placed(sent, 0), T.StructType([*placed, *rows]))
        owned = placed.repartitionById(owners, F.col("owner")).drop("owner").sortWithinPartitions("bucket", "_key")
        chain = T.StructType().add("bucket", T.IntegerType()).add("_key", T.LongType()).add("link", T.IntegerType()).add("_sha", T.BinaryType()).add("keep_id", id_type).add("group_size", T.LongType())
        chain = chain.add("_bytes", T.BinaryType()) if texts else chain
        owned.mapInArrow(_owner(to_arrow_type(id_type), texts), chain).write.mode("overwrite").parquet(f"{self.path}/chains-{old + 1:06d}")
        if not publish(self.spark, f"{self.path}/_directory/v{old + 1:06d}.json", directory.json()):
            raise RuntimeError(f"version {old + 1} was added by another writer")
        return old + 1


def keys_of(docs: DataFrame) -> DataFrame:
    """(_id, _row, _key, _sha) of documents (_id, _text): a hash of the text as it is, the key and the digest of the normalised one."""
    posting = T.StructType().add("_id", docs.schema["_id"].dataType).add("_row", T.LongType()).add("_key", T.LongType()).add("_sha", T.BinaryType())
    return docs.select("_id", "_text", F.xxhash64("_text").alias("_row")).mapInArrow(_keyed, posting)


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, index: HashIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256, bucket, link, row) for each row; of equal texts the smallest id stays.

    row is a hash of the text as it is, which tells rows apart that share an id. Ids may have any type that sorts.

    Texts are equal when they are once each run of white space is one space; null counts as empty. Rows without an
    id form groups too; they stay only where no row of the group has one. Rows that share id and text are all kept,
    or none. Empty tables give empty results; other columns are left out, whatever their names. With an index that
    holds documents already, these are added to it, and groups are of all.

    1. Each row's key and digest are written to the shared folder. 2. The directory doubles and splits its buckets by
    the number of different keys in each, as deep as these need; it is a file in the index. 3. Copies are combined in
    the task that reads them, then texts go to the task that owns their bucket's range of keys; it sorts them by key,
    which spills, chains those whose keys collide, and compares their bytes. The chains are files of the index. 4. Rows
    find their chain by key and digest; large groups are spread.
    """
    spark = python_ready(docs)
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    with saved(spark) as save:
        postings = save(keys_of(docs), "exact-postings", keep=True)
        own = index or HashIndex(spark, new_path(spark, "exact-index"), capacity)
        own.add(docs, postings, texts=index is not None)
        if index is None:
            forget(spark, own.path)
    out = hot_join(postings, own.chains().drop("_bytes"), ["_key", "_sha"], "group_size", postings.count(), F.col("_id"))
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"), "bucket", "link", F.col("_row").alias("row"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that exact_groups keeps, with their columns."""
    gone = exact_groups(docs, id_col=id_col, text_col=text_col, **options).filter("not kept").select(F.col(id_col).alias("_gone"), "row")
    return without(docs, gone, id_col, text_col, "exact-gone")
