"""Counts by event-time window, the same for a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "3 days") -> DataFrame:
    """(day, event_type, n, total) of events (ts, event_type, value); a stream drops rows later than `late`."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("at", late)
    g = e.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")
