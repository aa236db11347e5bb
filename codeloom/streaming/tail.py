"""Streams: counts by event time with late data, and an index that follows a folder of file rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need a time with a zone; one without is taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def event_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums of (ts, event_type, value) by window; events later than ``late`` are left out."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    grouped = _timed(events).withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Sessions of (ts, user_id): events of a user with less than ``gap`` between them."""
    grouped = _timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def follow(spark: SparkSession, folder: str, schema: str, checkpoint: str, step: Callable[[DataFrame, int], None], most_files: int = 1000) -> StreamingQuery:
    """Run ``step`` on each batch of new Parquet files of ``folder``, until none is left.

    The checkpoint remembers what was seen; a batch that failed is run again, so a step
    must give the same result twice.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)
    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
