"""Structured Streaming forms of series operators (an addition: the batch operators have no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean of each type and tumbling window; rows later than the watermark are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "mean")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, parted by gaps."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
    )


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain what is there into a memory table and return it."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
