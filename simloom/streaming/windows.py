"""Extension: event streams in windows of time, with late data and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums per key and window; on a stream, events later than allowed are left out."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    per = rows.groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return per.select(F.col("window.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes") -> DataFrame:
    per = events.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return per.select(F.col("session_window.start").alias("session_start"), key, "n")
