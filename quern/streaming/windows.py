"""Streaming face of the event queries; an extension, the batch engine doesn't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with a watermark, which needs an instant; a batch as it is."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) of tumbling windows; rows later than ``late`` are dropped when streaming."""
    src = _watermarked(events, ts, late)
    return src.groupBy(F.window(ts, width).alias("w"), F.col(kind)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, start, end, n) of runs of events without a longer gap."""
    src = _watermarked(events, ts, late)
    return src.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
