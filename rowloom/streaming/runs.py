"""Streams: records collected once, versions of a watched source with their differences, windows over events, states of jobs.

Every stream keeps its state and progress in the checkpoint that the caller names, in a folder all executors share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowloom.operators.snapshots import diff_records


def read_events(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def collected_once(records: DataFrame, keys: Sequence[str], at: str, delay: str = "1 day") -> DataFrame:
    """Records of a stream without those whose key came before, within the delay by which records may be late; the state of older keys is dropped."""
    return records.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def event_windows(events: DataFrame, at: str, by: Sequence[str], *, size: str = "1 hour", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """(window_start, by..., n, total, mean) of a stream or table in tumbling or sliding windows of event time; events later than the delay are dropped in a stream."""
    timed = events.withWatermark(at, delay) if events.isStreaming else events
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = timed.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n", "total", "mean")


def sessions(events: DataFrame, at: str, by: str, *, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """(by, session_start, session_end, n): runs of events without a pause longer than the gap."""
    timed = events.withWatermark(at, delay) if events.isStreaming else events
    g = timed.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def watch(records: DataFrame, path: str, checkpoint: str, unique_by: Sequence[str], order: str) -> StreamingQuery:
    """Writes every batch of a watched source as a version below a path, with its difference from the version before.

    A batch that is run again after a failure writes the same version, so nothing is counted twice.
    """

    def version(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        here = f"{path}/version={number}"
        batch.write.mode("overwrite").parquet(here)
        now = spark.read.parquet(here)
        before = spark.read.parquet(f"{path}/version={number - 1}") if number else now.limit(0)
        diff_records(before, now, unique_by, order).write.mode("overwrite").parquet(f"{path}-diff/version={number}")

    return records.writeStream.foreachBatch(version).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a Parquet folder, each row exactly once, until what has landed is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
