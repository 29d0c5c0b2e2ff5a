"""Streaming twins of grouped and windowed event features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """Event time with its zone, and on a stream the watermark."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late) if late and events.isStreaming else events


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", size: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Count, sum and mean of each key in tumbling windows; the same on a stream (with a watermark) and a table."""
    source = _timed(events, time, late)
    out = source.groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "mean")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", value: str = "value", gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """Sessions of each key: runs of events without a pause of ``gap``."""
    source = _timed(events, time, late)
    out = source.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
