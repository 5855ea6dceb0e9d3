"""The command line: scan, baseline, check, diff and explain over source and coverage files.

Status: 0 all well, 1 a gate failed, 2 usage or configuration.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.operators import calibration, churn, coverage, ladder, report
from hazardlens.plans import doctor, findings, render
from hazardlens.plans.config import Config, ConfigError, find
from hazardlens.sources import python_files, reports


def analyse(spark: SparkSession, root: str, c: Config, coverage_file: str | None = None, hunks: DataFrame | None = None) -> DataFrame:
    """The scored functions below ``root``. ``hunks`` (``commit, path, start, end``) gives churn; without them it is 0."""
    spark.catalog.refreshByPath(root)  # an earlier run of this session may have cached older files
    rows = python_files.parsed(python_files.scan(spark, root, exclude=c.exclude)).cache()
    units = python_files.functions(rows)
    units = units.withColumn("unit", F.concat_ws("#", "path", F.col("ordinal").cast("string")))
    facts = None
    if coverage_file:
        files = reports.coverage_files(spark.read.text(coverage_file, wholetext=True).select(F.lit("coverage").alias("report"), F.col("value").alias("text")))
        known = coverage.suffix_lookup(units, files.select(F.col("path").alias("record"), F.col("pos").alias("ordinal")))
        facts = _covered(units, files, known.withColumn("report", F.lit("coverage")), c.missing_coverage)
    elif texts := shards(spark, c.coverage, root):
        files = reports.coverage_files(reports.readable_coverage(reduce(DataFrame.unionByName, texts)))
        records = files.select(F.col("report").alias("prefix"), F.col("path").alias("record"))
        known = coverage.shard_lookup(units, spark.createDataFrame([(x,) for x in c.coverage], "prefix string"), records)
        facts = _covered(units, files, known.withColumnRenamed("prefix", "report"), c.missing_coverage)
    if facts is None:
        facts = units.withColumn("line_coverage", F.lit(1.0 if c.missing_coverage == "optimistic" else 0.0)).withColumn("branch_coverage", F.lit(None).cast("double"))
    if hunks is not None:
        facts = facts.join(churn.function_churn(units, hunks), "unit")
    else:
        facts = facts.withColumn("commits", F.lit(0).cast("long"))
    out = report.scored(facts, c.weights).withColumn("language", F.lit("python"))
    if c.groups:
        groups = spark.createDataFrame([(n, p) for n, ps in c.groups.items() for p in ps], "name string, prefix string")
        out = out.join(coverage.longest_prefix(out, groups), "path", "left")
    else:
        out = out.withColumn("group", F.lit(None).cast("string"))
    return report.suppressed(out, c.allow)[0]


def shards(spark: SparkSession, files: dict[str, str], root: str) -> list[DataFrame]:
    """``report, text`` of the coverage file of each path prefix (``report``); files that aren't there are skipped."""
    found = [(x, Path(root, f)) for x, f in files.items() if Path(root, f).is_file()]
    return [spark.read.text(str(f), wholetext=True).select(F.lit(x).alias("report"), F.col("value").alias("text")) for x, f in found]


def _covered(units: DataFrame, files: DataFrame, known: DataFrame, policy: str) -> DataFrame:
    """``units`` with the coverage of the ``record`` in ``report`` that is known for their path."""
    known = known.filter("record is not null")
    own = lambda df: df.withColumnRenamed("path", "record").join(known, ["report", "record"]).drop("report", "record")
    return coverage.with_coverage(units, own(reports.coverage_lines(files)), own(reports.coverage_arcs(files)), known.select("path"), policy)


def recent_hunks(spark: SparkSession, log: str, days: int, until: float) -> DataFrame:
    """Hunks of the last ``days`` before ``until`` (epoch seconds) in the text of a version history.

    The log comes from ``git log -p -U0 --no-color --format=%x00%H\\ %ct``: each commit begins with a zero character,
    at which the file is split, so a long history is read in parts.
    """
    at = F.timestamp_seconds(F.lit(float(until)))
    hunks = reports.log_hunks(spark.read.text(log, lineSep="\0"))
    return hunks.filter(F.col("ts") >= at - F.make_dt_interval(F.lit(days)))


def save_snapshot(rows: DataFrame, path: str) -> None:
    """A JSON file where ``path`` ends in .json, else a Parquet folder."""
    if not path.endswith(".json"):
        rows.write.mode("overwrite").parquet(path)
        return
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(render.snapshot_json(rows, reports.VERSIONS[-1]))


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """What ``save_snapshot`` wrote; JSON entries that can't be read are left out, of several of an id the last counts."""
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    texts = spark.read.text(path, wholetext=True).select(F.lit(path).alias("report"), F.col("value").alias("text"))
    return coverage.latest(reports.baseline_entries(texts).filter("ok"), ["path", "qualname"])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("hazardlens")
    p.add_argument("command", choices=("scan", "baseline", "check", "diff", "explain"))
    p.add_argument("root")
    p.add_argument("--coverage")
    p.add_argument("--snapshot", help="the baseline, a Parquet folder or a file ending in .json")
    p.add_argument("--format", choices=("table", "json", "markdown", "sarif", "github", "pr-comment"), default="table")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--min-score", type=float)
    p.add_argument("--fail-above", type=float)
    p.add_argument("--target")
    p.add_argument("--history", help="a log with diffs, for churn; see recent_hunks")
    p.add_argument("--until", type=float, help="end of the churn window in epoch seconds, else now")
    p.add_argument("--redact", action="store_true", help="replace paths and names in what is shown; baselines keep them")
    p.add_argument("--salt")
    p.add_argument("--revision", help="salt where nothing else gives one")
    a = p.parse_args(argv)
    try:
        c, _ = find(Path(a.root).resolve())
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    if a.command in ("baseline", "check", "diff") and not a.snapshot or a.command == "explain" and not a.target:
        print("an option is missing", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    hunks = recent_hunks(spark, a.history, c.churn_days, time.time() if a.until is None else a.until) if a.history else None
    scored = analyse(spark, a.root, c, a.coverage, hunks)
    salt = calibration.salt(a.salt, os.environ, c.salt, a.revision)
    hide = lambda rows: doctor.redact(rows, salt) if a.redact else rows
    if a.command == "explain":
        print(render.explained(scored, a.target))
        return 0
    if a.command == "baseline":
        if not scored.limit(1).count():
            print("no functions: the baseline is left alone", file=sys.stderr)
            return 2
        save_snapshot(ladder.baseline(scored), a.snapshot)
        return 0
    if a.command in ("check", "diff"):
        d = ladder.diff(scored, load_snapshot(spark, a.snapshot), c.regression_above, component_above=c.component_above)
        d = hide(findings.located(d, scored)).cache()
        failed = ladder.regressions(d, c.new_above, c.existing_above)
        print(findings.shown(findings.findings(d if a.command == "diff" else failed), a.format, a.command, a.top))
        return int(a.command == "check" and failed.limit(1).count() > 0)
    shown = hide(report.top(scored, a.top, a.min_score)).cache()
    how = {"table": render.report_text, "markdown": render.report_markdown, "sarif": render.sarif, "github": render.annotations, "pr-comment": render.comment}
    print("\n".join(r[0] for r in render.report_json(shown).collect()) if a.format == "json" else how[a.format](shown))
    return int(a.fail_above is not None and report.above(shown, a.fail_above).limit(1).count() > 0)


if __name__ == "__main__":
    sys.exit(main())
