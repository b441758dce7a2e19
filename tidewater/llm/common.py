"""Helpers that the operators share: tables in the shared folder, and joins on hot keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources import workers

#: A key with over 1/SLICES of the rows is spread over several tasks, so at most SLICES keys are hot.
SLICES = 1024
#: Rows and bytes that a worker takes in at once, at least one row.
ROWS, BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, on one machine only, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tidewater-shared"
    return base.rstrip("/")


def python_ready(df: DataFrame) -> SparkSession:
    """The session, whose Python workers can import this package."""
    return workers.python_ready(df.sparkSession)


@contextmanager
def python_task(*caches: dict) -> Iterator[None]:
    """Around a task's rows: no collection of cycles, of which row work makes none, and at its end no memory kept.

    A worker goes on to tasks of other operators; what it knows would add up with what those need.
    """
    gc.disable()
    try:
        yield
    finally:
        for known in caches:
            known.clear()
        gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # another C library than GNU's
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows and about `size` bytes, so that what a worker makes of one is bounded."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            if step > 1 and part.nbytes > 2 * size:  # rows of uneven length
                yield from (part.slice(i, 1) for i in range(part.num_rows))
            else:
                yield part


def fit_logistic(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, start: tuple[float, float]) -> tuple[float, float]:
    """Slope, above 0, and intercept of the logistic curve from x to labels, by Newton's method with a small penalty towards start."""
    rows, theta = np.stack([x, np.ones(len(x))], 1), np.array(start, float)

    def cost(at: np.ndarray) -> float:
        z = rows @ at
        return float((weights * (np.logaddexp(0, z) - labels * z)).sum() + 0.005 * ((at - start) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ theta, -30, 30)))
        slope = rows.T @ (weights * (p - labels)) + 0.01 * (theta - start)
        step = np.linalg.solve((rows * (weights * p * (1 - p))[:, None]).T @ rows + 0.01 * np.eye(2), slope)
        while abs(step).max() > 1e-9 and cost(theta - step) > cost(theta):
            step = step / 2
        theta = theta - step
        if abs(step).max() < 1e-7:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path as it takes it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with this text appear whole under its path; False if there is one already."""
    fs, final = filesystem(spark, path)
    temporary = filesystem(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")[1]
    out = fs.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(final) and fs.rename(temporary, final):
        return True
    fs.delete(temporary, False)
    return False


def contents(spark: SparkSession, path: str) -> str:
    fs, p = filesystem(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    fs, p = filesystem(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a table in the shared folder and rereads it: this cuts the lineage, and any executor can go."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Tables that lazy results read; they go when the driver's Python ends.
_kept: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    for spark, path in _kept:
        with suppress(Exception):  # a session that was stopped has no file system any more
            remove(spark, path)


def forget(spark: SparkSession, path: str) -> None:
    """Notes a folder that goes when the driver's Python ends."""
    _kept.append((spark, path))


@contextmanager
def saved(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """save(df, name) for the tables of one operator: they go at its end, but for those with keep=True, which its lazy result reads."""
    paths: list[str] = []

    def write(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        out, path = save(df, name)
        forget(spark, path) if keep else paths.append(path)
        return out

    try:
        yield write
    finally:
        for path in paths:
            remove(spark, path)


def hot_join(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, total: int, spread: Column, how: str = "inner") -> DataFrame:
    """left joined to right, whose keys are unique and whose column weight says how many rows of left have the key.

    A key with over 1/SLICES of the total rows of left is cut into slices of that size: right repeats its row for
    each slice, left deals its rows by `spread`. Only the hot keys, at most SLICES rows, are broadcast.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col(weight) * SLICES / F.lit(max(total, 1)))).cast("int")
    right = right.withColumn("_slices", n)
    hot = right.filter("_slices > 1").select(*keys, F.col("_slices").alias("_n"))
    left = left.join(F.broadcast(hot), list(keys), "left").withColumn("_slice", F.pmod(F.xxhash64(spread), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    right = right.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    return left.join(right, [*keys, "_slice"], how).drop("_slice")


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """docs without the rows whose id and text's hash are among gone (_gone, row), which is written first; a null id equals another.

    Both are joined by the hash of the text too, so rows without an id are dealt out like any others.
    """
    with saved(docs.sparkSession) as save:
        gone = save(gone.distinct(), name, keep=True)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & F.xxhash64(docs[text_col]).eqNullSafe(gone["row"]), "left_anti")
