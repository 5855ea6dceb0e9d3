"""Calibration tables: rescored candidates, paired comparisons, correlation matrices, review flags, run digests."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions import scoring
from hazardlens.operators import model, statistics


def rescored(report: DataFrame, sprawl: Column, weights: dict[str, float] | None = None) -> DataFrame:
    """``report`` with another sprawl and the total that follows; severity and all else stay as they were."""
    out = report.withColumn("sprawl", sprawl)
    return out.withColumn("score", scoring.total({c: F.col(c) for c in scoring.COMPONENTS}, weights))


def mean_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, and mean and median to 3 places, null without values."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v), 3).alias("mean"), F.round(F.percentile(v, F.lit(0.5)), 3).alias("median"))


def separation(df: DataFrame, value: str, accepted: str, by: Sequence[str]) -> DataFrame:
    """How ``value`` separates accepted from rejected rows under each candidate: effect, AUC, means and medians of both."""
    v, yes = F.col(value).cast("double"), F.col(accepted)
    of = lambda name, cond: [F.round(F.avg(F.when(cond, v)), 3).alias(f"mean_{name}"), F.round(F.percentile(F.when(cond, v), F.lit(0.5)), 3).alias(f"median_{name}")]
    both = df.groupBy(*by).agg(*of("accepted", yes), *of("rejected", ~yes))
    return statistics.mann_whitney(df, value, accepted, by).select(*by, "n1", "n0", "effect", "auc").join(both, list(by))


def paired(a: DataFrame, b: DataFrame, value: str = "auc", by: str = "repo") -> DataFrame:
    """One row: groups scored in both, mean of ``a`` less ``b``, and in how many it is above and other than 0."""
    x = a.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("_a"))
    y = b.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("_b"))
    d = F.col("_a") - F.col("_b")
    return x.join(y, by).agg(F.count("*").alias("groups"), F.avg(d).alias("mean_delta"), F.count_if(d > 0).alias("wins"), F.count_if(d != 0).alias("decided"))


def mean_auc(scores: DataFrame) -> DataFrame:
    """One row: the mean of ``auc`` over groups and the mean weighted by their sizes ``n`` (null AUCs left out)."""
    n = F.when(F.col("auc").isNotNull(), F.col("n"))
    return scores.agg(F.avg("auc").alias("mean_auc"), (F.sum(F.col("auc") * n) / F.nullif(F.sum(n), F.lit(0))).alias("weighted_auc"))


def tier_gradient(df: DataFrame, tier: str, value: str, tiers: Sequence[str]) -> DataFrame:
    """Rows and mean of ``value`` for each of ``tiers``, those without rows included."""
    own = df.groupBy(tier).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    every = df.sparkSession.createDataFrame([(t,) for t in tiers], f"{tier} string")
    return every.join(own, tier, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def correlation_matrix(df: DataFrame, pairs: Sequence[tuple[str, str]], corpus: str, pooled: str = "pooled") -> DataFrame:
    """``corpus, pair, n, pearson, spearman`` (4 places) for each pair of columns, by corpus and over all of them.

    Rows go out once for each pair and twice for the pool; ranks come from counts of distinct values.
    """
    each = F.array(*[F.struct(F.lit(f"{x}~{y}").alias("pair"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in pairs])
    rows = df.select(F.array(F.col(corpus), F.lit(pooled)).alias("c"), F.explode(each).alias("p")).select(F.explode("c").alias("corpus"), "p.*")
    by = ["corpus", "pair"]
    ranked = statistics.average_rank(statistics.average_rank(rows, "x", by, "rx"), "y", by, "ry")
    four = lambda c: F.round(c, 4)
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"), four(statistics.correlation(F.col("x"), F.col("y"))).alias("pearson"), four(statistics.correlation(F.col("rx"), F.col("ry"))).alias("spearman"))


def review_flags(comments: DataFrame, by: Sequence[str], flagged: Column) -> DataFrame:
    """Flagged comments for each key, keys without any left out."""
    return comments.filter(flagged).groupBy(*by).agg(F.count("*").alias("flags"))


def run_digest(runs: DataFrame) -> DataFrame:
    """One row over replayed runs (``repo, label``): how many, how many labelled, and the repos in order."""
    return runs.agg(F.count("*").alias("n_prs"), F.count_if(F.col("label").isNotNull() & (F.col("label") != "unlabeled")).alias("n_labeled"), F.sort_array(F.collect_set("repo")).alias("repos"))


def union(first: DataFrame, second: DataFrame) -> DataFrame:
    """The report of two language backends; columns that one lacks are null."""
    return first.unionByName(second, allowMissingColumns=True)


def union_summary(first: DataFrame, second: DataFrame) -> DataFrame:
    """One-row run summaries put together: counts add up, ``coverage_status`` is true if either is."""
    counts = [c for c in first.columns if c != "coverage_status"]
    status = [F.bool_or("coverage_status").alias("coverage_status")] if "coverage_status" in first.columns else []
    return first.unionByName(second).agg(*[F.sum(c).alias(c) for c in counts], *status)


#: Features of the full defect model, and of the one for changes (which leaves past changes to its baseline).
FEATURES = {
    "cyclomatic": lambda: F.col("cyclomatic"), "length": lambda: F.log1p(F.col("n_lines")), "file_length": lambda: F.log1p(F.col("file_lines")),
    "uncovered": lambda: 1 - F.col("line_coverage"), "branch": lambda: 1 - F.coalesce("branch_coverage", F.lit(1.0)), "public": lambda: F.col("is_public").cast("double"), "commits": lambda: F.log1p(F.col("commits")),
}
SHORT = ("cyclomatic", "length", "file_length", "public", "commits")


def features(facts: DataFrame, names: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """``target`` and ``features``, an array in the order of ``names``; ``file_lines`` is the length of the function's file."""
    return facts.select("target", F.array(*[FEATURES[n]().cast("double") for n in names]).alias("features"))


def model_comparison(df: DataFrame, null: Sequence[str], full: Sequence[str]) -> DataFrame:
    """One row: paired deltas of the full model over the null model, each scored on repos that it wasn't fitted on."""
    return paired(model.leave_one_out(df, full), model.leave_one_out(df, null))


def payload(rows: DataFrame, order: Sequence[str], places: int = 4) -> str:
    """A report table (as short as its groups) as JSON: sorted rows, rounded numbers, null for what isn't a number."""

    def plain(x):
        if isinstance(x, float):
            return round(x, places) if math.isfinite(x) else None
        return x

    got = [{k: plain(v) for k, v in r.asDict().items()} for r in rows.orderBy(*order).collect()]
    return json.dumps(got, indent=2, sort_keys=True)


def salt(flag: str | None, environment: Mapping[str, str], configured: str | None, commit: str | None, variable: str = "HAZARDLENS_SALT") -> str | None:
    """The salt of redacted ids: from the command line, else the environment, the configuration, the commit; else none."""
    return flag or environment.get(variable) or configured or commit or None
