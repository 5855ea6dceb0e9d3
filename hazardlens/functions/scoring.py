"""Column builders of the risk score. All constants are doubles and sums keep one fixed order."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default weights, bands and severity bounds of the score.
COMPONENTS = ("coverage_gap", "structural_complexity", "branch_gap", "churn", "public_surface", "sprawl")
WEIGHTS = {"coverage_gap": 0.30, "structural_complexity": 0.25, "branch_gap": 0.15, "churn": 0.10, "public_surface": 0.10, "sprawl": 0.10}
COMPLEXITY_BAND, CHURN_BAND, LENGTH_BAND = (1.0, 21.0), (0.0, 10.0), (80.0, 160.0)
SEVERITIES = (("critical", 75.0), ("high", 50.0), ("medium", 25.0))


def resolve_weights(overrides: Mapping[str, float] | None = None) -> dict[str, float]:
    """Defaults with ``overrides``, scaled to a sum of 1. Unknown names and bad numbers raise ``ValueError``."""
    merged = {**WEIGHTS, **(overrides or {})}
    if unknown := sorted(set(merged) - set(WEIGHTS)):
        raise ValueError(f"unknown weights: {', '.join(unknown)}")
    for name, w in merged.items():
        if isinstance(w, bool) or not isinstance(w, (int, float)) or not math.isfinite(w) or w < 0:
            raise ValueError(f"weight {name} must be a number of 0 or more")
    total = sum(float(w) for w in merged.values())
    if total <= 0:
        raise ValueError("some weight must be above 0")
    return {name: float(w) / total for name, w in merged.items()}


def saturating(value: Column, band: tuple[float, float]) -> Column:
    """0 up to the band's lower end, 100 from its upper end on, linear between."""
    free, full = band
    if full <= free:
        raise ValueError("a band's upper end must be above its lower end")
    v = value.cast("double")
    return F.when(v <= free, F.lit(0.0)).when(v >= full, F.lit(100.0)).otherwise((v - free) / (full - free) * 100.0)


def gap(share: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - share)) * 100.0


def components(line_coverage, branch_coverage, cyclomatic, commits, is_public, n_lines, complexity_band=COMPLEXITY_BAND) -> dict[str, Column]:
    """The six components, each 0 to 100. Branch coverage may be null (not measured): no gap."""
    line_gap = gap(line_coverage)
    return {
        "coverage_gap": line_gap,
        "structural_complexity": saturating(cyclomatic, complexity_band),
        "branch_gap": F.when(branch_coverage.isNull(), F.lit(0.0)).otherwise(gap(branch_coverage)),
        "churn": saturating(commits, CHURN_BAND),
        "public_surface": F.when(is_public, line_gap).otherwise(F.lit(0.0)),
        "sprawl": saturating(n_lines, LENGTH_BAND),
    }


def total(parts: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    w = weights or WEIGHTS
    out = None
    for name in COMPONENTS:
        term = parts[name] * F.lit(float(w[name]))
        out = term if out is None else out + term
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), out))


def crap(cyclomatic: Column, line_coverage: Column) -> Column:
    uncovered = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - line_coverage))
    c = cyclomatic.cast("double")
    return c * c * (uncovered * uncovered * uncovered) + c


def severity(score: Column) -> Column:
    """Bands include their lower bound; NaN is low."""
    out = F.when(F.isnan(score), F.lit("low"))
    for name, least in SEVERITIES:
        out = out.when(score >= least, F.lit(name))
    return out.otherwise(F.lit("low"))


def argmax_growth(current: Mapping[str, Column], previous: Mapping[str, Column], tolerance: float) -> Column:
    """``struct<name, before, after, delta>`` of the component that grew most, if by more than ``tolerance``; else null.

    Of equal growth, the first in declared order.
    """
    rows = F.array(
        *[
            F.struct((current[c] - previous[c]).alias("delta"), F.lit(-i).alias("order"), F.lit(c).alias("name"), previous[c].alias("before"), current[c].alias("after"))
            for i, c in enumerate(COMPONENTS)
        ]
    )
    best = F.array_max(F.filter(rows, lambda x: x["delta"] > F.lit(float(tolerance))))
    return F.when(best.isNotNull(), F.struct(best["name"].alias("name"), best["before"].alias("before"), best["after"].alias("after"), best["delta"].alias("delta")))
