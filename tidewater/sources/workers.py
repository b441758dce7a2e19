"""Letting Python workers import this package."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def python_ready(spark: SparkSession | None = None) -> SparkSession:
    """The session, whose Python workers can import this package from where the driver has it, if it is there too."""
    spark = spark or SparkSession.active()
    context = spark.sparkContext
    root, known = str(Path(__file__).resolve().parents[2]), context.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, on one machine only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or f"file://{tempfile.mkdtemp(prefix='tidewater-')}").rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """Lets checkpoint() write to the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
