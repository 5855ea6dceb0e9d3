"""Penalised logistic models over scored functions, and candidate formulas."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardlens.functions.scoring import LENGTH_BAND, saturating


def candidate_sprawl(units: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every unit under every candidate (``key, fw, tw, a, b``): the function's share and the file's over its own band."""
    total = F.sum("n_lines").over(Window.partitionBy("path")).cast("double")
    rows = units.withColumn("total", total).crossJoin(F.broadcast(candidates))  # a fixed list of formulas
    t = F.col("total")
    file = F.when(t <= F.col("a"), F.lit(0.0)).when(t >= F.col("b"), F.lit(100.0)).otherwise((t - F.col("a")) / (F.col("b") - F.col("a")) * 100.0)
    return rows.withColumn("sprawl", F.col("fw") * saturating(F.col("n_lines"), LENGTH_BAND) + F.col("tw") * file)


def solve(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Minimises the log-loss plus half ``l2`` times the squared weights, by Newton steps; no separate intercept."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + l2 * np.eye(len(w)), x.T @ (y - p) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w


def design(x: np.ndarray, group: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    names, at = np.unique(group, return_inverse=True)
    return np.hstack([(x - mean) / scale, np.eye(len(names))[at]])


def auc(score: np.ndarray, y: np.ndarray) -> float:
    rank = pd.Series(score).rank().to_numpy()
    n1, n0 = y.sum(), len(y) - y.sum()
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")


def leave_one_out(df: DataFrame, features: Sequence[str], l2: float = 1.0) -> DataFrame:
    """Per ``repo``: AUC on it of slopes fitted on all other repos, and its size and positives.

    Repos are replicated to one fit each (their number is small by design); a fit runs in one task, in parallel.
    """
    k = list(features)
    repos = df.select(F.col("repo").alias("held")).distinct()
    rows = df.select("repo", *k, "label", "target").crossJoin(F.broadcast(repos))

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        held = own["held"].iloc[0]
        own = own.sort_values(["repo", "target"])
        train, test = own[own.repo != held], own[own.repo == held]
        x = train[k].to_numpy(float)
        mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        w = solve(design(x, train.repo.to_numpy(), mean, scale), train.label.to_numpy(float), l2)
        score = ((test[k].to_numpy(float) - mean) / scale) @ w[: len(k)]
        y = test.label.to_numpy()
        a = auc(score, y)
        return pd.DataFrame({"repo": [held], "n": [len(y)], "positives": [int(y.sum())], "auc": [None if np.isnan(a) else a]})

    return rows.groupBy("held").applyInPandas(fit, "repo string, n long, positives long, auc double")


def bootstrap_interval(df: DataFrame, features: Sequence[str], name: str, draws: int = 1000, seed: int = 0, l2: float = 1.0) -> DataFrame:
    """One row: the pooled coefficient of ``name`` and its 95 % interval over draws of whole repos.

    Repos are drawn on the driver from a seeded generator; a repo drawn twice counts as two.
    """
    k = list(features)
    repos = sorted(r[0] for r in df.select("repo").distinct().collect())
    rng = np.random.default_rng(seed)
    picks = [(0, i, r) for i, r in enumerate(repos)] + [(d + 1, i, repos[j]) for d in range(draws) for i, j in enumerate(rng.integers(0, len(repos), len(repos)))]
    drawn = df.sparkSession.createDataFrame(picks, "draw int, copy int, repo string")
    rows = df.select("repo", "target", *k, "label").join(drawn, "repo")

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["copy", "target"])
        x = own[k].to_numpy(float)
        scale = np.where(x.std(0) > 0, x.std(0), 1.0)
        w = solve(design(x, own["copy"].to_numpy(), x.mean(0), scale), own.label.to_numpy(float), l2)
        return pd.DataFrame({"draw": [own["draw"].iloc[0]], "w": [w[k.index(name)]]})

    fits = rows.groupBy("draw").applyInPandas(fit, "draw int, w double")
    pooled = F.max(F.when(F.col("draw") == 0, F.col("w")))
    w = F.when(F.col("draw") > 0, F.col("w"))
    return fits.agg(pooled.alias("coefficient"), F.percentile(w, F.lit(0.025)).alias("low"), F.percentile(w, F.lit(0.975)).alias("high"))
