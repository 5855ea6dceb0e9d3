"""Churn: which commits' hunks touch which functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 64


def overlapping(units: DataFrame, hunks: DataFrame, bin_size: int | None = BIN) -> DataFrame:
    """Units joined with the hunks (``commit, path, start, end``) of their path that overlap their closed span.

    Both sides are dealt out by line bins first, so that files with very many rows stay linear; a pair is kept in
    the one bin where the later of the two begins, so nothing has to be made distinct. Merge joins, as in ``coverage``.
    """
    meets = (F.col("start") <= F.col("end_line")) & (F.col("start_line") <= F.col("end"))
    if bin_size is None:
        return units.join(hunks.hint("merge"), "path").where(meets)
    lot = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.col(b) / bin_size)))
    joined = units.withColumn("_bin", lot("start_line", "end_line")).join(hunks.withColumn("_bin", lot("start", "end")).hint("merge"), ["path", "_bin"])
    return joined.where(meets & (F.col("_bin") == F.floor(F.greatest("start_line", "start") / bin_size))).drop("_bin")


def since(hunks: DataFrame, cutoff) -> DataFrame:
    """Hunks from ``cutoff`` (a literal: results don't depend on the clock) on."""
    return hunks.filter(F.col("ts") >= F.lit(cutoff))


def function_churn(units: DataFrame, hunks: DataFrame, bin_size: int | None = BIN) -> DataFrame:
    """``unit, commits``: distinct commits that touch each unit, 0 included."""
    n = overlapping(units, hunks, bin_size).groupBy("unit").agg(F.countDistinct("commit").alias("commits"))
    return units.select("unit").join(n.hint("merge"), "unit", "left").select("unit", F.coalesce("commits", F.lit(0)).alias("commits"))


def file_churn(hunks: DataFrame) -> DataFrame:
    return hunks.groupBy("path").agg(F.countDistinct("commit").alias("commits"))


def change_counts(units: DataFrame, hunks: DataFrame) -> DataFrame:
    """``unit, commits, lines``: a commit counts once a unit; lines are whole hunks, not the overlap."""
    size = F.col("end") - F.col("start") + 1
    each = overlapping(units, hunks).groupBy("unit", "commit").agg(F.sum(size).alias("lines"))
    return each.groupBy("unit").agg(F.count("*").alias("commits"), F.sum("lines").alias("lines"))
