"""Comparing a report with a baseline: exact ids, unique fingerprints, then weighted renames.

Rows have ``path, qualname, ordinal, score``, the six components, ``fingerprint, signature, group, language``. A match
without an equal body fingerprint stays below the threshold whatever else agrees (0.45 of 0.65 at most), so the rename
search is an equi-join on the fingerprint, and rows of different fingerprints never compete for the same old row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardlens.functions.names import tail, target
from hazardlens.functions.scoring import COMPONENTS, argmax_growth
from hazardlens.operators import coverage
from hazardlens.operators.coverage import latest

# Weights of the rename signals, their bounds, and the gates' defaults.
BODY, SIGNATURE, PATH, TAIL, SHAPE, SCORE = 0.55, 0.20, 0.10, 0.05, 0.05, 0.05
SHAPE_LEAST, SCORE_MOST, MATCH, BAND = 0.95, 2.0, 0.65, 0.05
NEW_ABOVE, REGRESSION_ABOVE, COMPONENT_ABOVE = 50.0, 5.0, 15.0
STATUS_ORDER = ("regressed", "component_regressed", "ambiguous_rename", "new", "improved", "moved", "removed", "unchanged")


def _d(x: float) -> Column:
    return F.lit(float(x))


def cosine(a: list[Column], b: list[Column]) -> Column:
    """Cosine of two vectors: 1 if both are zero, 0 if one is."""
    total = lambda xs: sum(xs[1:], xs[0])
    dot, na, nb = total([x * y for x, y in zip(a, b, strict=True)]), total([x * x for x in a]), total([y * y for y in b])
    return F.when((na == 0) & (nb == 0), _d(1)).when((na == 0) | (nb == 0), _d(0)).otherwise(dot / F.nullif(F.sqrt(na) * F.sqrt(nb), _d(0)))


def similarity(n: str = "n", o: str = "o") -> Column:
    """Weighted similarity of the aliased rows ``n`` (current) and ``o`` (baseline), rounded to 6 places."""
    c = lambda side, name: F.col(f"{side}.{name}")
    yes = lambda cond, w: F.when(F.coalesce(cond, F.lit(False)), _d(w)).otherwise(_d(0))
    score = yes(c(n, "fingerprint") == c(o, "fingerprint"), BODY) + yes(c(n, "signature") == c(o, "signature"), SIGNATURE)
    score = score + yes(c(n, "path") == c(o, "path"), PATH) + yes(tail(c(n, "qualname")) == tail(c(o, "qualname")), TAIL)
    shape = cosine([c(n, x) for x in COMPONENTS], [c(o, x) for x in COMPONENTS])
    score = score + yes(shape >= _d(SHAPE_LEAST), SHAPE) + yes(F.abs(c(n, "score") - c(o, "score")) <= _d(SCORE_MOST), SCORE)
    return F.round(score, 6)


def baseline(report: DataFrame) -> DataFrame:
    """A snapshot: the last row of each id, scores rounded to 4 places."""
    return latest(report, ["path", "qualname"]).withColumn("score", F.round("score", 4))


def exact(new: DataFrame, old: DataFrame) -> DataFrame:
    """Current rows whose id is in the baseline, with ``old_path, old_qualname``."""
    ids = old.select("path", "qualname", F.col("path").alias("old_path"), F.col("qualname").alias("old_qualname"))
    return new.join(ids, ["path", "qualname"])


def by_fingerprint(new: DataFrame, old: DataFrame) -> DataFrame:
    """Current rows not in the baseline by id, matched by a body fingerprint that is unique on either side."""
    once = lambda df: df.filter("fingerprint is not null").withColumn("_n", F.count("*").over(Window.partitionBy("fingerprint"))).filter("_n = 1").drop("_n")
    ids = ["path", "qualname"]
    free_new = once(new).join(old.select(ids), ids, "left_anti")
    free_old = once(old).join(new.select(ids).distinct(), ids, "left_anti")
    return free_new.join(free_old.select("fingerprint", F.col("path").alias("old_path"), F.col("qualname").alias("old_qualname")), "fingerprint")


def leftover(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of either side for the rename step."""
    ids = ["path", "qualname"]
    taken = by_fingerprint(new, old)
    rest_new = new.join(old.select(ids), ids, "left_anti").join(taken.select(*ids), ids, "left_anti").filter("fingerprint is not null")
    used = taken.select(F.col("old_path").alias("path"), F.col("old_qualname").alias("qualname"))
    rest_old = old.join(new.select(ids).distinct(), ids, "left_anti").join(used, ids, "left_anti").filter("fingerprint is not null")
    return rest_new, rest_old


def rename_candidates(new: DataFrame, old: DataFrame) -> DataFrame:
    """Scored pairs of leftover rows: both ids, ``similarity``, whether it is near the row's best (ambiguity band)."""
    n, o = leftover(new, old)
    pairs = n.alias("n").join(o.alias("o"), F.col("n.fingerprint") == F.col("o.fingerprint"))
    pairs = pairs.select(
        F.col("n.path").alias("path"), F.col("n.qualname").alias("qualname"), F.col("n.ordinal").alias("ordinal"), F.col("n.fingerprint").alias("fingerprint"),
        F.col("o.path").alias("old_path"), F.col("o.qualname").alias("old_qualname"), similarity().alias("similarity"),
    )
    best = F.max("similarity").over(Window.partitionBy("path", "qualname", "ordinal"))
    return pairs.withColumn("best", best).withColumn("near_top", (F.col("best") >= _d(MATCH)) & (F.col("best") - F.col("similarity") <= _d(BAND)))


RENAME = "path string, qualname string, ordinal long, old_path string, old_qualname string, confidence double, ambiguous boolean, candidates string"


def renames(new: DataFrame, old: DataFrame) -> DataFrame:
    """The greedy pass: rows in report order, each taking its best old row unless several are near it.

    Competition is confined to one fingerprint, so each fingerprint's candidates are decided on their own. A body
    shared by very many functions makes one large group: k rows times m old rows.
    """

    def decide(pairs: pd.DataFrame) -> pd.DataFrame:
        used: set[tuple[str, str]] = set()
        out = []
        for (ordinal, path, qualname), own in pairs.groupby(["ordinal", "path", "qualname"], sort=True):
            free = [(s, p, q) for s, p, q in zip(own.similarity, own.old_path, own.old_qualname, strict=True) if (p, q) not in used and s > 0]
            free.sort(key=lambda x: (-x[0], f"{x[1]}::{x[2]}"))
            if not free or free[0][0] < MATCH:
                continue
            near = [x for x in free if free[0][0] - x[0] <= BAND]
            if len(near) > 1:
                names = ",".join(f"{p}::{q}" for _, p, q in near)
                out.append((path, qualname, ordinal, None, None, near[0][0], True, names))
            else:
                s, p, q = near[0]
                used.add((p, q))
                out.append((path, qualname, ordinal, p, q, s, False, None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in RENAME.split(", ")])

    return rename_candidates(new, old).groupBy("fingerprint").applyInPandas(decide, RENAME)


def classified(new: DataFrame, old: DataFrame) -> DataFrame:
    """Every current row with ``step`` (exact, fingerprint, rename, ambiguous or none), its old id and confidence."""
    keys = ["path", "qualname", "ordinal"]
    e = exact(new, old).select(*keys, "old_path", "old_qualname", F.lit("exact").alias("step"), F.lit(None).cast("double").alias("confidence"))
    f = by_fingerprint(new, old).select(*keys, "old_path", "old_qualname", F.lit("fingerprint").alias("step"), _d(1).alias("confidence"))
    r = renames(new, old).select(*keys, "old_path", "old_qualname", F.when(F.col("ambiguous"), "ambiguous").otherwise("rename").alias("step"), "confidence")
    found = e.unionByName(f).unionByName(r)
    return new.join(found, keys, "left").withColumn("step", F.coalesce("step", F.lit("none")))


def _with_previous(new: DataFrame, old: DataFrame, component_above: float = COMPONENT_ABOVE) -> DataFrame:
    before = old.select(F.col("path").alias("old_path"), F.col("qualname").alias("old_qualname"), F.col("score").alias("previous_score"), F.col("group").alias("old_group"), *[F.col(c).alias(f"old_{c}") for c in COMPONENTS])
    out = classified(new, old).join(before, ["old_path", "old_qualname"], "left").withColumn("delta", F.col("score") - F.col("previous_score"))
    grown = argmax_growth({c: F.col(c) for c in COMPONENTS}, {c: F.col(f"old_{c}") for c in COMPONENTS}, component_above)
    return out.withColumn("grown", F.when(F.col("previous_score").isNotNull(), grown))


def diff(new: DataFrame, old: DataFrame, regression_above: float = REGRESSION_ABOVE, component_gate: bool = True, component_above: float = COMPONENT_ABOVE) -> DataFrame:
    """One row per current function, and per baseline row that is gone, with its ``status``.

    Precedence: regressed, improved, component regressed, moved, unchanged; bounds are strict.
    """
    m = _with_previous(new, old, component_above)
    status = (
        F.when(F.col("step") == "ambiguous", "ambiguous_rename").when(F.col("step") == "none", "new")
        .when(F.col("delta") > _d(regression_above), "regressed").when(F.col("delta") < -_d(regression_above), "improved")
        .when(F.lit(component_gate) & F.col("grown").isNotNull(), "component_regressed")
        .when(F.col("step") != "exact", "moved").otherwise("unchanged")
    )
    group = F.coalesce("group", "old_group")
    rows = m.select("path", "qualname", group.alias("group"), status.alias("status"), F.col("score").alias("current_score"), "previous_score", "delta",
                    F.when(F.col("step") != "exact", F.col("old_path")).alias("previous_path"), F.when(F.col("step") != "exact", F.col("old_qualname")).alias("previous_qualname"),
                    "confidence", F.col("grown.name").alias("component"), F.col("grown.delta").alias("component_delta"))
    nothing = {"current_score": "double", "delta": "double", "previous_path": "string", "previous_qualname": "string", "confidence": "double", "component": "string", "component_delta": "double"}
    used = m.filter("old_path is not null").select(F.col("old_path").alias("path"), F.col("old_qualname").alias("qualname"))
    gone = removed(old, new, used).select("path", "qualname", "group", F.lit("removed").alias("status"), F.col("score").alias("previous_score"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    return rows.unionByName(gone)


def removed(old: DataFrame, new: DataFrame, used: DataFrame) -> DataFrame:
    ids = ["path", "qualname"]
    return old.join(used.select(ids).distinct(), ids, "left_anti").join(new.select(ids).distinct(), ids, "left_anti")


def diff_order(rows: DataFrame) -> DataFrame:
    """Status, then size of the change (a delta of 0 falls through to the scores), then target."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    size = F.coalesce(*[F.nullif(F.col(c), _d(0)) for c in ("delta", "current_score", "previous_score")], _d(0))
    return rows.orderBy(place, -F.abs(size), target(F.col("path"), F.col("qualname")))


def regressions(rows: DataFrame, new_above: float = NEW_ABOVE, existing_above: float | None = None) -> DataFrame:
    """The gate on a diff: ambiguous renames always fail, new rows above a bound, regressed and component-regressed rows."""
    score = F.coalesce("current_score", _d(0))
    kind = (
        F.when(F.col("status") == "ambiguous_rename", "new_above_threshold").when((F.col("status") == "new") & (score > _d(new_above)), "new_above_threshold")
        .when(F.col("status").isin("regressed", "component_regressed"), F.col("status"))
    )
    if existing_above is not None:
        kind = kind.when(F.col("status").isin("improved", "moved", "unchanged") & (score > _d(existing_above)), "existing_above_threshold")
    fresh = F.col("status").isin("ambiguous_rename", "new")
    out = rows.withColumn("kind", kind).filter("kind is not null")
    more = [c for c in ("component", "component_delta", "start_line", "end_line") if c in rows.columns]
    return out.select("path", "qualname", "group", "kind", score.alias("current_score"), F.when(~fresh, F.col("previous_score")).alias("previous_score"), F.when(~fresh, F.col("delta")).alias("delta"), *more)


def compare(new: DataFrame, old: DataFrame, new_above: float = NEW_ABOVE, regression_above: float = REGRESSION_ABOVE, existing_above: float | None = None) -> DataFrame:
    """The second gate. It has no improved status, so a component may fail though the total fell; its delta is the component's."""
    m = _with_previous(new, old)
    kind = (
        F.when(F.col("step") == "ambiguous", "new_above_threshold").when((F.col("step") == "none") & (F.col("score") > _d(new_above)), "new_above_threshold")
        .when(F.col("delta") > _d(regression_above), "regressed").when(F.col("grown").isNotNull(), "component_regressed")
    )
    if existing_above is not None:
        kind = kind.when(F.col("previous_score").isNotNull() & (F.col("score") > _d(existing_above)), "existing_above_threshold")
    delta = F.when(F.col("kind") == "component_regressed", F.col("grown.delta")).otherwise(F.col("delta"))
    return m.withColumn("kind", kind).filter("kind is not null").select("path", "qualname", "kind", F.col("score").alias("current_score"), "previous_score", delta.alias("delta"))


def score_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many ids changed (scores to 6 places), were added or removed."""
    x = a.select("path", "qualname", F.round("score", 6).alias("x"), F.lit(1).alias("in_a"))
    y = b.select("path", "qualname", F.round("score", 6).alias("y"), F.lit(1).alias("in_b"))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return x.join(y, ["path", "qualname"], "full_outer").agg(
        F.count_if(both & ~F.col("x").eqNullSafe(F.col("y"))).alias("changed"), F.count_if(F.col("in_a").isNull()).alias("added"), F.count_if(F.col("in_b").isNull()).alias("removed"))


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Diff rows whose group, taken from the current row or the baseline, is else that of the longest prefix of their path."""
    by_path = coverage.longest_prefix(rows.filter("group is null"), groups, "_prefix")
    return rows.join(by_path, "path", "left").withColumn("group", F.coalesce("group", "_prefix")).drop("_prefix")
