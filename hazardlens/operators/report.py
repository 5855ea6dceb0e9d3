"""The scored report: filters, order, roll-ups and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions import scoring
from hazardlens.functions.names import allowed, target

SEVERITIES = ("critical", "high", "medium", "low")
STATUSES = ("regressed", "component_regressed", "ambiguous_rename", "new", "improved", "moved", "removed", "unchanged")


def scored(facts: DataFrame, weights: dict[str, float] | None = None, band=scoring.COMPLEXITY_BAND) -> DataFrame:
    """``facts`` (coverage, complexity, churn, span columns) plus the six components, ``score``, ``crap``, ``severity``."""
    n = F.col("end_line") - F.col("start_line") + 1
    parts = scoring.components(*(F.col(c) for c in ("line_coverage", "branch_coverage", "cyclomatic", "commits", "is_public")), n, band)
    out = facts.withColumns(parts)
    out = out.withColumn("score", scoring.total({c: F.col(c) for c in scoring.COMPONENTS}, weights))
    return out.withColumn("crap", scoring.crap(F.col("cyclomatic"), F.col("line_coverage"))).withColumn("severity", scoring.severity(F.col("score")))


def risk_order(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("score"), target(F.col("path"), F.col("qualname")))


def top(report: DataFrame, k: int = 20, min_score: float | None = None) -> DataFrame:
    """Rows of ``min_score`` or more, the ``k`` riskiest."""
    rows = report if min_score is None else report.filter(F.col("score") >= F.lit(float(min_score)))
    return risk_order(rows).limit(k)


def suppressed(report: DataFrame, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows that an allow pattern suppresses."""
    hit = allowed(F.col("path"), F.col("qualname"), patterns)
    return report.filter(~hit), report.filter(hit)


def counts_by(column: str, values: tuple[str, ...], prefix: str = "") -> list[Column]:
    """One count for each value, zeros included."""
    return [F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values]


def severity_histogram(report: DataFrame) -> DataFrame:
    return report.agg(*counts_by("severity", SEVERITIES))


def group_rollup(report: DataFrame) -> DataFrame:
    """Per group (null: ``ungrouped``): functions, highest score, severities."""
    name = F.coalesce("group", F.lit("ungrouped")).alias("group")
    return report.groupBy(name).agg(F.count("*").alias("functions"), F.max("score").alias("max_score"), *counts_by("severity", SEVERITIES))


def status_rollup(diff: DataFrame) -> DataFrame:
    """Counts by status for each group, and in all (group null)."""
    named = diff.withColumn("group", F.coalesce("group", F.lit("ungrouped")))
    return named.rollup("group").agg(*counts_by("status", STATUSES))


KINDS = ("new_above_threshold", "regressed", "component_regressed", "existing_above_threshold")


def regression_rollup(regressions: DataFrame) -> DataFrame:
    """Regressions by kind for each group, and in all (group null)."""
    named = regressions.withColumn("group", F.coalesce("group", F.lit("ungrouped")))
    return named.rollup("group").agg(*counts_by("kind", KINDS))


def gate_rollup(regressions: DataFrame, diff: DataFrame) -> DataFrame:
    """``regression_rollup``, or where nothing regressed the diff's roll-up by status."""
    return regression_rollup(regressions) if regressions.limit(1).count() else status_rollup(diff)


def regression_order(regressions: DataFrame) -> DataFrame:
    """The largest change first (a delta that is null or 0 falls through to the score), then by target."""
    size = F.coalesce(F.nullif("delta", F.lit(0.0)), "current_score")
    return regressions.orderBy(F.desc(size), target(F.col("path"), F.col("qualname")))


def above(report: DataFrame, threshold: float) -> DataFrame:
    """The gate without a baseline: scores strictly above ``threshold``."""
    return report.filter(F.col("score") > F.lit(float(threshold)))


def at_or_above(report: DataFrame, severity: str) -> DataFrame:
    return report.filter(F.col("severity").isin(*SEVERITIES[: SEVERITIES.index(severity) + 1]))


def run_summary(report: DataFrame, suppressed_rows: DataFrame) -> DataFrame:
    """One row: analyzed, emitted and suppressed functions and the severities."""
    a = report.agg(F.count("*").alias("emitted"), *counts_by("severity", SEVERITIES))
    b = suppressed_rows.agg(F.count("*").alias("suppressed"))
    return a.crossJoin(b).withColumn("analyzed", F.col("emitted") + F.col("suppressed"))
