"""Event-time windows, sessions and repeats; each works on a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with `ts` as a time that a watermark takes; on a batch the watermark has no effect."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def counted(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Count and sum of values per window and type: tumbling, or sliding with `slide`."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed(events).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: runs of events less than a gap apart."""
    return timed(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without repeats of a key that arrive within the watermark."""
    out = timed(events, late)
    return out.dropDuplicatesWithinWatermark(keys) if out.isStreaming else out.dropDuplicates(keys)
