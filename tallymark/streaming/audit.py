"""Audit counts and changes of a growing log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def operation_counts(log: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Entries by window and operation; entries later than `lateness` are dropped. Works on streams and tables."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    if log.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    counts = timed.groupBy(F.window("ts", window).alias("w"), "operation").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "operation", "n")
