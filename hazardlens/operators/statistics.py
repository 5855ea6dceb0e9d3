"""Rank statistics, distributions and quantile bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Ranks from 1 with ties sharing their mean.

    Ranks come from counts of distinct values, summed up in order: rows themselves never pass through one ordered
    window. (Without ``by`` the distinct values do.)
    """
    keys = list(by)
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(name, F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / F.lit(2.0)).drop("_n")
    return df.join(ranks, [*keys, value])


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null with fewer than two rows or no variance (never an error)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    scale = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (scale > 0), F.covar_pop(a, b) / F.nullif(scale, F.lit(0.0)))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(correlation(F.col(x), F.col(y)).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    ranked = average_rank(average_rank(df, x, by, "_rx"), y, by, "_ry")
    return ranked.groupBy(*by).agg(correlation(F.col("_rx"), F.col("_ry")).alias("spearman"))


def mann_whitney(df: DataFrame, value: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """``n1, n0, u, effect, auc, z``: rank-biserial effect and tie-corrected z of positives against the rest.

    Null effect where a group is empty.
    """
    keys = list(by)
    each = df.groupBy(*keys, value).agg(F.count("*").alias("t"), F.count_if(F.col(positive)).alias("p"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("r", F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / F.lit(2.0))
    s = each.groupBy(*keys).agg(
        F.sum("p").alias("n1"), F.sum(F.col("t") - F.col("p")).alias("n0"), F.sum(F.col("r") * F.col("p")).alias("r1"),
        F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("ties"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.col("r1") - n1 * (n1 + 1) / 2
    var = n1 * n0 / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0)))
    out = s.withColumn("u", u).withColumn("effect", 2 * F.col("u") / F.nullif(n1 * n0, F.lit(0.0)) - 1)
    out = out.withColumn("auc", (F.col("effect") + 1) / 2).withColumn("z", (F.col("u") - n1 * n0 / 2) / F.nullif(F.sqrt(var), F.lit(0.0)))
    return out.select(*keys, "n1", "n0", "u", "effect", "auc", "z")


def distribution(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, least, p25, median, p75, most, zeros`` and ten bins of width 10 (values clamped to the outer bins).

    Quartiles are the values at index round-half-even(p * (n - 1)).
    """
    keys = list(by)
    numbered = df.select(*keys, F.col(value).cast("double").alias("v"))
    numbered = numbered.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1)
    numbered = numbered.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    at = lambda p: F.max(F.when(F.col("i") == F.bround(F.lit(p) * (F.col("n") - 1), 0).cast("long"), F.col("v")))
    lot = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("v") / 10)))
    bins = [F.count_if(lot == i).alias(f"bin{i}") for i in range(10)]
    return numbered.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("v").alias("least"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"),
        F.max("v").alias("most"), (F.count_if(F.col("v") == 0) / F.count("*")).alias("zeros"), *bins)


def quantiles(df: DataFrame, value: str, at: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Mean (3 places) and linearly interpolated quantiles."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(v), 3).alias("mean"), *[F.percentile(v, F.lit(p)).alias(k) for k, p in at.items()])


def matched_band(source: DataFrame, target: DataFrame, value: str, free: float, full: float) -> DataFrame:
    """The band of ``target`` at the percentiles where ``source`` has ``free`` and ``full``; at least 1 and above it."""
    share = lambda x: F.avg((F.col(value) <= F.lit(x)).cast("double"))
    p = source.agg(share(free).alias("p_free"), share(full).alias("p_full")).first()
    at = target.agg(*[F.percentile(F.col(value).cast("double"), F.lit(p[k])).alias(f"raw_{k[2:]}") for k in ("p_free", "p_full")])
    low = F.greatest(F.lit(1.0), F.bround("raw_free", 0))
    return at.select(F.lit(p["p_free"]).alias("p_free"), F.lit(p["p_full"]).alias("p_full"), "raw_free", "raw_full", low.alias("free"), F.greatest(low + 1, F.bround("raw_full", 0)).alias("full"))


def top_quantile(df: DataFrame, by: str, order: Sequence[Column], part: float = 0.25, positive: str = "commits") -> DataFrame:
    """Adds ``chosen``: among the first ceil(part * n) rows of its group in ``order``, and ``positive`` above 0."""
    k = F.ceil(F.lit(part) * F.count("*").over(Window.partitionBy(by)))
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("chosen", (place <= k) & (F.col(positive) > 0))


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean over their population deviation (0 counts as 1)."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))  # one row
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return out.withColumns(scaled).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided sign test at one half."""
    from math import comb

    n = wins + losses
    if not n:
        return 1.0
    return min(1.0, 2 * sum(comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n)
