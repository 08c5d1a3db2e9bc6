"""Counts of events by windows of event time, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, by: str, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by, n, total) of each window; state is dropped once the watermark, `late` behind the newest event, passes."""
    timed = events.withColumn("_at", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("_at", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
