"""Checks around a run: does coverage fit the sources, may a baseline be written, is a change of it explained."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions.names import redacted, target
from hazardlens.operators.coverage import suffix_lookup

# Fixed value: characters, blanks apart, that a rationale has at least.
RATIONALE_LEAST = 20


@dataclass(frozen=True)
class Finding:
    name: str
    status: str  # ok, warn or fail
    detail: str


def coverage_overlap(files: DataFrame, records: DataFrame, most: int = 200) -> Finding:
    """How many of the first ``most`` source files (by path) have a coverage record; a warning for none or under half."""
    some = files.select("path").distinct().orderBy("path").limit(most)
    n, hit = suffix_lookup(some, records).agg(F.count("*"), F.count("record")).first()
    status = "ok" if not n or 2 * hit >= n else "warn"
    return Finding("coverage overlap", status, f"{hit} of {n} files have coverage")


def branch_data(arcs: DataFrame) -> Finding:
    some = arcs.limit(1).count()
    return Finding("branch data", "ok" if some else "warn", "branches measured" if some else "no branch was measured")


def tally(findings: list[Finding]) -> dict[str, int]:
    return {s: sum(f.status == s for f in findings) for s in ("ok", "warn", "fail")}


def may_replace(report: DataFrame, baseline: DataFrame | None) -> Finding:
    """An empty report never replaces a baseline that has rows, and is never compared with one."""
    empty = not report.limit(1).count()
    full = baseline is not None and bool(baseline.limit(1).count())
    return Finding("baseline", "fail" if empty and full else "ok", "the scan found no functions" if empty else "functions found")


def explained(changed: bool, body: str = "", labels: tuple[str, ...] = (), messages: tuple[str, ...] = (), label: str = "baseline-approved", token: str = "[baseline]") -> Finding:
    """A changed baseline needs a rationale line in the request's text, a label, or a token in a commit message."""
    if not changed:
        return Finding("rationale", "ok", "the baseline is unchanged")
    m = re.search(r"(?im)^\s*baseline rationale:\s*(.+)$", body)
    enough = bool(m) and len(re.sub(r"\s", "", m[1])) >= RATIONALE_LEAST
    fine = enough or label in labels or any(token in x for x in messages)
    return Finding("rationale", "ok" if fine else "fail", "explained" if fine else "say why the baseline changes")


def fresh(sources: DataFrame, cache_time) -> bool:
    """Whether no source (``modificationTime``, from the binary file source) is newer than the cached coverage."""
    newest = sources.agg(F.max("modificationTime")).first()[0]
    return newest is None or newest <= cache_time


def redact(report: DataFrame, salt: str | None = None, columns: tuple[str, ...] = ("path", "qualname")) -> DataFrame:
    """Ids replaced by their redaction, also where they occur in ``reason``; scores stay."""
    new = {c: redacted(F.col(c), salt) for c in columns}
    if "reason" not in report.columns:
        return report.withColumns(new)
    return report.withColumn("reason", _scrubbed(F.col("reason"), salt)).withColumns(new)


def _scrubbed(reason: Column, salt: str | None) -> Column:
    """Whole occurrences of the target, the path and the qualified name, in this order (no name inside a word counts)."""
    path, name = F.col("path"), F.col("qualname")
    new = F.concat_ws("::", redacted(path, salt), redacted(name, salt))
    for old, to in ((target(path, name), new), (path, redacted(path, salt)), (name, redacted(name, salt))):
        whole = F.concat(F.lit("(?<![0-9A-Za-z_./])\\Q"), old, F.lit("\\E(?![0-9A-Za-z_])"))
        reason = F.regexp_replace(reason, whole, to)
    return reason


def split_in_half(units: DataFrame, small: int = 500, large: int = 1000) -> DataFrame:
    """The what-if of halving one file: the longest strictly between the bounds, else the longest; adds ``total_lines`` after."""
    sizes = units.groupBy("path").agg(F.sum("n_lines").alias("total_lines"))
    inside = (F.col("total_lines") > small) & (F.col("total_lines") < large)
    pick = sizes.agg(F.max_by("path", F.struct(inside.alias("in"), F.col("total_lines"), F.col("path"))).alias("chosen"))
    halved = F.when(F.col("path") == F.col("chosen"), F.floor(F.col("total_lines") / 2)).otherwise(F.col("total_lines"))
    return units.join(sizes, "path").crossJoin(F.broadcast(pick)).withColumn("total_lines", halved).drop("chosen")
