"""Reports as text, Markdown, JSON, SARIF, annotations and comments. Spark orders and limits; the driver formats few rows."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlens.functions.names import target
from hazardlens.functions.scoring import COMPONENTS
from hazardlens.operators.ladder import diff_order
from hazardlens.operators.report import SEVERITIES, STATUSES, risk_order

LEVELS = {"critical": "error", "high": "warning", "medium": "warning", "low": "note"}
COMMENT_ROWS, COMMENT_CHARS, SARIF_LEAST, ADVICE_FROM = 20, 60_000, 25.0, 50.0
ADVICE = {
    "coverage_gap": "add tests for the lines that none runs", "structural_complexity": "split up branching logic", "branch_gap": "test the branches that are never taken",
    "churn": "stabilise code that changes often", "public_surface": "test what callers rely on", "sprawl": "shorten the function",
}


def report_json(report: DataFrame, k: int | None = None) -> DataFrame:
    """One JSON string per function in risk order, null fields kept."""
    rows = risk_order(report) if k is None else risk_order(report).limit(k)
    named = F.struct(target(F.col("path"), F.col("qualname")).alias("target"), *[F.col(c) for c in rows.columns])
    return rows.select(F.to_json(named, {"ignoreNullFields": "false"}).alias("json"))


def snapshot_json(rows: DataFrame, version: str) -> Iterator[str]:
    """A snapshot as the text of one JSON document, in the order of targets, row by row."""
    own = [c for c in ("path", "qualname", "score", "fingerprint", "signature", "group", "language") if c in rows.columns]
    entry = F.struct(*own, F.struct(*COMPONENTS).alias("components"))
    yield f'{{"version": {json.dumps(version)}, "entries": ['
    gap = "\n"
    for r in rows.orderBy(target(F.col("path"), F.col("qualname"))).select(F.to_json(entry)).toLocalIterator():
        yield gap + r[0]
        gap = ",\n"
    yield "\n]}\n"


def signed(x: float | None) -> str:
    return "n/a" if x is None else f"{x:+.1f}"


def table(rows: Iterable, columns: list[str], hidden: int = 0) -> str:
    """Left-aligned text columns; doubles with one place."""
    cells = [[f"{r[c]:.1f}" if isinstance(r[c], float) else "" if r[c] is None else str(r[c]) for c in columns] for r in rows]
    width = [max(map(len, [c, *[x[i] for x in cells]])) for i, c in enumerate(columns)]
    lines = ["  ".join(c.ljust(w) for c, w in zip(x, width, strict=True)).rstrip() for x in [columns, *cells]]
    return "\n".join([*lines, *([f"{hidden} more hidden"] if hidden else [])])


def report_text(report: DataFrame, k: int = 20) -> str:
    n = report.count()
    return table(risk_order(report).limit(k).collect(), ["severity", "score", "path", "qualname"], max(0, n - k))


def diff_text(rows: DataFrame, k: int = 20) -> str:
    n = rows.count()
    return table(diff_order(rows).limit(k).collect(), ["status", "previous_score", "current_score", "path", "qualname"], max(0, n - k))


def report_markdown(report: DataFrame, k: int = 20) -> str:
    cells = lambda r: f"| {r['severity']} | {r['score']:.1f} | `{r['path']}::{r['qualname']}` |"
    return "\n".join(["| severity | score | function |", "| --- | ---: | --- |", *map(cells, risk_order(report).limit(k).collect())])


def cut_at_lines(text: str, most: int = COMMENT_CHARS) -> str:
    """``text``, or its whole lines that fit with a note; an open details block is closed."""
    if len(text) <= most:
        return text
    note, close = "\n\n_Cut: too long for a comment._", "\n</details>"
    kept, size = [], len(note) + len(close)
    for line in text.split("\n"):
        size += len(line) + 1
        if size > most:
            break
        kept.append(line)
    out = "\n".join(kept)
    return out + (close if out.count("<details>") > out.count("</details>") else "") + note


def comment(report: DataFrame) -> str:
    """High and critical functions first, the rest collapsed."""
    n, rows = report.count(), risk_order(report).limit(5_000).collect()
    line = lambda r: f"| {r['severity']} | {r['score']:.1f} | `{r['path']}::{r['qualname']}` |"
    head = ["| severity | score | function |", "| --- | ---: | --- |"]
    top = [r for r in rows if r["severity"] in SEVERITIES[:2]][:COMMENT_ROWS]
    rest = [r for r in rows if r not in top]
    parts = ["## Risk report", "", *head, *map(line, top)]
    if rest:
        parts += ["", "<details>", f"<summary>{n - len(top)} more</summary>", "", *head, *map(line, rest), "", "</details>"]
    return cut_at_lines("\n".join(parts))


def sarif(report: DataFrame, least: float | None = SARIF_LEAST) -> str:
    rows = report if least is None else report.filter(F.col("score") >= F.lit(float(least)))
    results = [
        {"ruleId": "function-risk", "level": LEVELS[r["severity"]], "message": {"text": f"{r['qualname']}: risk {r['score']:.1f} ({r['severity']})"},
         "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}, "region": {"startLine": r["start_line"], "endLine": r["end_line"]}}}]}
        for r in risk_order(rows).toLocalIterator()
    ]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "hazardlens", "rules": [{"id": "function-risk"}]}}, "results": results}]})


def annotations(report: DataFrame, k: int = 20) -> str:
    def safe(x: object) -> str:
        return str(x).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace(":", "%3A")

    level = {"error": "error", "warning": "warning", "note": "notice"}
    rows = risk_order(report).limit(k).collect()
    return "\n".join(f"::{level[LEVELS[r['severity']]]} file={safe(r['path'])},line={r['start_line']}::{safe(r['qualname'])} risk {r['score']:.1f}" for r in rows)


def source_link(base: str, ref: str, path: str, start: int, end: int) -> str:
    return f"{base.rstrip('/')}/blob/{ref}/{path}#L{start}-L{end}"


def explained(report: DataFrame, name: str) -> str:
    """Components and advice of the first function with that target."""
    r = report.filter(target(F.col("path"), F.col("qualname")) == name).orderBy("ordinal").first()
    if r is None:
        raise LookupError(name)
    lines = [f"{name}: {r['score']:.1f} ({r['severity']})", *[f"  {c}: {r[c]:.1f}" for c in COMPONENTS]]
    todo = [ADVICE[c] for c in COMPONENTS if r[c] >= ADVICE_FROM]
    return "\n".join([*lines, *(["  " + "; ".join(todo)] if todo else [])])


def summary_lines(summary: dict, groups: list[dict]) -> str:
    out = [f"{k}={v}" for k, v in summary.items()]
    return "\n".join([*out, *[f"group.{g['group']}={g['functions']}" for g in sorted(groups, key=lambda g: g["group"])]])


def status_counts(rows: DataFrame) -> dict[str, int]:
    r = rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]).first()
    return r.asDict()
