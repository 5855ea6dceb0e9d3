"""Regressions and diffs as tables, Markdown, comments, SARIF, annotations and JSON envelopes.

``located`` gives a diff the line spans of the current report; ``findings`` brings either table into one form, whose rows
have a ``label`` (kind or status) and a ``reason``. Spark orders and limits; the driver formats what is shown.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hazardlens.functions.names import target
from hazardlens.functions.scoring import severity
from hazardlens.operators import ladder, report
from hazardlens.plans import render

#: Statuses of a diff that comments and annotations show.
SHOWN = ("regressed", "component_regressed", "ambiguous_rename", "new")
VERSION = 1
FIELDS = ("label", "path", "qualname", "group", "previous_score", "current_score", "delta", "reason")


def located(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Diff rows plus ``start_line, end_line`` of the first function of that id; null for removed ones."""
    span = F.min_by(F.struct("start_line", "end_line"), "ordinal").alias("span")
    spans = scored.groupBy("path", "qualname").agg(span).select("path", "qualname", "span.*")
    return rows.join(spans, ["path", "qualname"], "left")


def reason(label: Column) -> Column:
    """What happened, in words without ids, so that redaction needs no second look."""
    by = lambda c: F.format_string("%.1f", F.coalesce(c, F.lit(0.0)))
    grown = F.concat(F.coalesce("component", F.lit("a component")), F.lit(" grew by "), by(F.col("component_delta")))
    fixed = {
        "new_above_threshold": "above the bound of functions that the baseline lacks", "existing_above_threshold": "above the bound of known functions",
        "ambiguous_rename": "several functions of the baseline are as similar", "new": "not in the baseline", "removed": "only in the baseline",
        "moved": "moved or renamed", "unchanged": "within the bounds",
    }
    out = F.when(label == "regressed", F.concat(F.lit("score grew by "), by(F.col("delta")))).when(label == "component_regressed", grown)
    out = out.when(label == "improved", F.concat(F.lit("score fell by "), by(-F.col("delta"))))
    for k, text in fixed.items():
        out = out.when(label == k, text)
    return out


def findings(rows: DataFrame) -> DataFrame:
    """A diff (``status``) or regressions (``kind``) in their order, with ``label``, ``reason`` and ``severity`` (null if gone)."""
    kind = "kind" if "kind" in rows.columns else "status"
    label = F.col(kind)
    level = F.when(F.col("current_score").isNotNull(), severity(F.col("current_score")))
    out = rows.withColumns({"label": label, "reason": reason(label), "severity": level})
    return report.regression_order(out) if kind == "kind" else ladder.diff_order(out)


def _score(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.1f}"


def text(rows: DataFrame, k: int = 20) -> str:
    n = rows.count()
    if not n:
        return "nothing to report"
    return render.table(rows.limit(k).collect(), [c for c in FIELDS if c != "group"], max(0, n - k))


HEAD = ["| what | function | before | after | change | reason |", "| --- | --- | ---: | ---: | ---: | --- |"]


def _line(r: Row) -> str:
    name = f"{r['path']}::{r['qualname']}".replace("|", "\\|")
    return f"| {r['label']} | `{name}` | {_score(r['previous_score'])} | {_score(r['current_score'])} | {render.signed(r['delta'])} | {r['reason']} |"


def markdown(rows: DataFrame, k: int | None = None) -> str:
    shown = rows.collect() if k is None else rows.limit(k).collect()
    return "\n".join([*HEAD, *map(_line, shown)]) if shown else "_Nothing to report._"


def comment(rows: DataFrame, k: int = render.COMMENT_ROWS, most: int = render.COMMENT_CHARS) -> str:
    """The first ``k`` rows, those after them collapsed, cut at a line to ``most`` characters.

    No more rows are fetched than can fit; the summary counts them all.
    """
    n = rows.count()
    got = rows.limit(k + most // len(HEAD[1])).collect()
    parts = ["## Risk changes", "", *([*HEAD, *map(_line, got[:k])] if got else ["_Nothing to report._"])]
    if n > k:
        parts += ["", "<details>", f"<summary>{n - k} more</summary>", "", *HEAD, *map(_line, got[k:]), "", "</details>"]
    return render.cut_at_lines("\n".join(parts), most)


def sarif(rows: DataFrame) -> str:
    """Every row that is still there, whatever its score; ids without a span point at line 1."""

    def result(r: Row) -> dict:
        region = {"startLine": r["start_line"] or 1, "endLine": r["end_line"] or 1}
        own = {c: r[c] for c in ("label", "previous_score", "current_score", "delta")}
        message = f"{r['path']}::{r['qualname']}: {r['reason']}, risk {r['current_score']:.1f} ({r['severity']})"
        where = {"physicalLocation": {"artifactLocation": {"uri": r["path"]}, "region": region}}
        return {"ruleId": "risk-change", "level": render.LEVELS[r["severity"]], "message": {"text": message}, "locations": [where], "properties": own}

    results = [result(r) for r in rows.filter("current_score is not null").toLocalIterator()]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "hazardlens", "rules": [{"id": "risk-change"}]}}, "results": results}]})


def annotations(rows: DataFrame) -> str:
    """One warning for each row that still has a function; without a span it names the file alone."""
    escaped = F.col("reason")
    for old, new in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (":", "%3A")):
        escaped = F.replace(escaped, F.lit(old), F.lit(new))
    span = F.when(F.col("start_line").isNotNull(), F.format_string(",line=%d,endLine=%d", "start_line", "end_line")).otherwise("")
    lines = rows.filter("current_score is not null").select(F.concat(F.lit("::warning file="), F.col("path"), span, F.lit("::"), escaped))
    return "\n".join(r[0] for r in lines.toLocalIterator())


def envelope(rows: DataFrame, command: str) -> Iterator[str]:
    """A JSON document of command, counts by label and entries, row by row; null fields are kept."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()}
    entry = F.to_json(F.struct(target(F.col("path"), F.col("qualname")).alias("target"), *FIELDS, "severity"), {"ignoreNullFields": "false"})
    yield f'{{"version": {VERSION}, "command": {json.dumps(command)}, "summary": {json.dumps(counts)}, "entries": ['
    gap = "\n"
    for r in rows.select(entry).toLocalIterator():
        yield gap + r[0]
        gap = ",\n"
    yield "\n]}"


def shown(rows: DataFrame, how: str, command: str, k: int = 20) -> str:
    """``rows`` (see ``findings``) in one of the formats of the command line.

    Annotations and comments of a diff leave out what neither regressed nor is new.
    """
    if command == "diff" and how in ("github", "pr-comment"):
        rows = rows.filter(F.col("label").isin(*SHOWN))
    if how == "json":
        return "".join(envelope(rows, command))
    return text(rows, k) if how == "table" else {"markdown": markdown, "pr-comment": comment, "sarif": sarif, "github": annotations}[how](rows)
