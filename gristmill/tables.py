"""Tables that steps keep in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, local mode alone has a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = Path(tempfile.mkdtemp(prefix="gristmill-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def findable(spark: SparkSession) -> None:
    """Let Python workers import this package (on a cluster it is installed or sent with --py-files)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when it has ended, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def kept(df: DataFrame, name: str, sort: tuple[str, ...] = (), compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_released(spark):
        (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def drop_kept(*tables: DataFrame) -> None:
    """Remove tables that kept() has written, once nothing reads them any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.kept_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
