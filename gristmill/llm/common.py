"""Helpers that the training-data operators share: how workers find this package, and which sides are broadcast."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.tables import drop_kept, fresh_path, kept, shared_dir

__all__ = ["broadcast_if_small", "drop_kept", "free_name", "fresh_path", "kept", "prepare", "release", "shared_dir", "table", "text_or_empty"]

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows that go to a Python worker at once; texts may be long, so Spark's default is too many.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package (on a cluster it is installed or sent with --py-files), and bound their batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def release() -> None:
    """Give memory that a finished task of this worker has freed back to the system; the worker may idle on."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def free_name(docs: DataFrame, name: str) -> str:
    """name, or one like it that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """A broadcast hint for a side whose rows have been counted; beyond the limit Spark shuffles it (and splits hot keys)."""
    return F.broadcast(df) if rows <= limit else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
