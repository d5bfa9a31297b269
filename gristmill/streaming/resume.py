"""Incremental work: files are taken as they come, finished keys are left out, failed ones are set aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(spark: SparkSession, source: str, schema: str, glob: str, state: str, key: str, work: Callable[[DataFrame], DataFrame], failed: Column) -> tuple[DataFrame, DataFrame]:
    """Run all files of source that weren't seen before through work, once each, and return (done, failed) so far.

    state has the stream's checkpoint and the tables of results and failures. A key that is in either isn't worked
    again, so a batch that is repeated after a crash adds nothing. Remove state to start anew.
    """
    done, dead = f"{state}/done", f"{state}/failed"

    def empty(path: str, like: DataFrame) -> DataFrame:
        try:
            return spark.read.schema(like.schema).parquet(path)
        except Exception:  # the table comes into being with the first batch
            return spark.createDataFrame([], like.schema)

    def batch(rows: DataFrame, number: int) -> None:
        once = rows.dropDuplicates([key])
        fresh = once.join(empty(done, work(rows)).select(key), key, "left_anti").join(empty(dead, rows).select(key), key, "left_anti")
        bad = F.coalesce(failed, F.lit(True))
        # each batch has a folder of its own, so doing it again replaces what a broken run left
        work(fresh.filter(~bad)).write.mode("overwrite").parquet(f"{done}/batch={number}")
        fresh.filter(bad).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(done).drop("batch"), spark.read.parquet(dead).drop("batch")


def counts_by_window(events: DataFrame, when: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by window and event type of a stream with a watermark; each window is given once it is closed."""
    return events.withWatermark(when, late).groupBy(F.window(when, width), "event_type").agg(F.count("*").alias("n"))
