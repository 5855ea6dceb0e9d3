"""Churn over a stream of commits: an extension, as batch windows have no state to carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(commits: DataFrame, late: str = "1 day", width: str = "7 days", time: str = "ts", key: str = "path") -> DataFrame:
    """Changes per ``key`` and window of a streaming (or batch) frame; rows later than ``late`` are dropped."""
    rows = commits.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(F.window(time, width), key).agg(F.count("*").alias("changes"))
    return out.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "changes")
