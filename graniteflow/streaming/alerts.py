"""Windowed counts of errors over a stream of events, with a watermark for late rows; the same on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_windows(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """start and n of each sliding window with errors. A stream keeps the windows within ``late`` of its newest row."""
    errors = events.where("event_type = 'error'")
    if events.isStreaming:
        errors = errors.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return errors.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def alerts(events: DataFrame, least: int = 3, **window: str) -> DataFrame:
    """Windows with ``least`` errors and more."""
    return error_windows(events, **window).where(F.col("n") >= least)
