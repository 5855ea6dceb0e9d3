"""JSON reports as tables: Python coverage, Istanbul coverage, baselines, hunks, pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardlens.functions.names import basename, diff_path


def _entries(text: Column, path: str | None = None) -> Column:
    """A JSON object's members as a map of variants; null if it is none."""
    inner = text if path is None else F.get_json_object(text, path)
    return F.from_json(inner, "map<string,variant>")


def coverage_files(texts: DataFrame) -> DataFrame:
    """``report, pos, path, basename, payload``: files of coverage reports (``report, text``); members that aren't objects are dropped.

    A report without an object ``files`` raises when rows are made.
    """
    m = _entries(F.col("text"), "$.files")
    good = F.get_json_object("text", "$.files").rlike("^\\s*\\{")
    checked = F.when(F.coalesce(good, F.lit(False)), m).otherwise(F.raise_error(F.concat(F.lit("not a coverage report: "), F.col("report"))).cast("map<string,variant>"))
    rows = texts.select("report", F.posexplode(checked).alias("pos", "path", "payload"))
    rows = rows.filter(F.schema_of_variant("payload").startswith("OBJECT"))
    return rows.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/"))).withColumn("basename", basename(F.col("path")))


def coverage_lines(files: DataFrame) -> DataFrame:
    """``report, path, line, executed``."""
    def of(key: str, executed: bool) -> DataFrame:
        v = F.try_variant_get("payload", f"$.{key}", "array<int>")
        return files.select("report", "path", F.explode(v).alias("line"), F.lit(executed).alias("executed"))

    return of("executed_lines", True).unionByName(of("missing_lines", False))


def coverage_arcs(files: DataFrame) -> DataFrame:
    """``report, path, pos, src, dst, executed``; arcs that aren't pairs are ignored."""
    def of(key: str, executed: bool) -> DataFrame:
        v = F.try_variant_get("payload", f"$.{key}", "array<array<int>>")
        rows = files.select("report", "path", F.posexplode(v).alias("pos", "a")).filter(F.size("a") == 2)
        return rows.select("report", "path", "pos", F.get("a", F.lit(0)).alias("src"), F.get("a", F.lit(1)).alias("dst"), F.lit(executed).alias("executed"))

    return of("executed_branches", True).unionByName(of("missing_branches", False))


def istanbul(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements (``path, line, hits``) and branches (``path, ordinal, line, arms``); a file's last report (``ordinal``) wins."""
    rows = texts.select("ordinal", F.explode(_entries(F.col("text"))).alias("path", "p"))
    newest = F.max("ordinal").over(Window.partitionBy("path"))
    rows = rows.withColumn("_n", newest).filter("ordinal = _n").select("path", F.to_json("p").alias("p"))
    at = rows.select("path", F.explode(_entries(F.col("p"), "$.statementMap")).alias("id", "loc"), F.from_json(F.get_json_object("p", "$.s"), "map<string,int>").alias("s"))
    statements = at.select("path", F.try_variant_get("loc", "$.start.line", "int").alias("line"), F.coalesce(F.try_element_at("s", "id"), F.lit(0)).alias("hits"))
    b = rows.select("path", F.explode(_entries(F.col("p"), "$.branchMap")).alias("id", "loc"), F.from_json(F.get_json_object("p", "$.b"), "map<string,array<int>>").alias("b"))
    arms = b.select("path", F.col("id").try_cast("int").alias("ordinal"), F.try_variant_get("loc", "$.loc.start.line", "int").alias("line"), F.try_element_at("b", "id").alias("arms"))
    return statements.filter("line is not null"), arms.filter("line is not null and arms is not null")


BASELINE = "array<variant>"
VERSIONS = ("1", "2", "3")


def baseline_entries(texts: DataFrame) -> DataFrame:
    """Entries of baseline files (``report, text``): ``report, ordinal, ok`` and their fields; bad entries have ``ok`` false.

    Files whose version isn't known, or without an array of entries, raise. A missing version is the current one, a
    missing language Python. The last of several entries of an id counts (see ``operators.coverage.latest``).
    """
    version = F.coalesce(F.get_json_object("text", "$.version"), F.lit(VERSIONS[-1]))
    raw = F.get_json_object("text", "$.entries")
    ok = version.isin(*VERSIONS) & raw.rlike("^\\s*\\[")
    good = F.when(F.coalesce(ok, F.lit(False)), F.from_json(raw, BASELINE)).otherwise(F.raise_error(F.concat(F.lit("unreadable baseline: "), F.col("report"))).cast(BASELINE))
    rows = texts.select("report", F.posexplode(good).alias("ordinal", "e"))
    get = lambda k, t: F.try_variant_get("e", f"$.{k}", t)
    parts = [F.coalesce(get(f"components.{c}", "double"), F.lit(0.0)).alias(c) for c in ("coverage_gap", "structural_complexity", "branch_gap", "churn", "public_surface", "sprawl")]
    out = rows.select("report", "ordinal", get("path", "string").alias("path"), get("qualname", "string").alias("qualname"), get("score", "double").alias("score"), *parts,
                      get("fingerprint", "string").alias("fingerprint"), get("signature", "string").alias("signature"), get("group", "string").alias("group"), F.coalesce(get("language", "string"), F.lit("python")).alias("language"))
    return out.withColumn("ok", F.col("path").isNotNull() & F.col("qualname").isNotNull() & F.col("score").isNotNull())


def hunks(texts: DataFrame, side: str = "new", keep_empty: bool = True) -> DataFrame:
    """``commit, path, start, end, raw_count`` of diffs without context (``commit, text``).

    A missing count is 1. A count of 0 gives the one line at its start, or no row if not ``keep_empty``. Combined diffs
    of merges have no such hunks.
    """
    sign, group = ("\\+\\+\\+ ", 3) if side == "new" else ("--- ", 1)
    rows = texts.select("commit", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    so_far = Window.partitionBy("commit").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("line").rlike("^" + sign), F.struct(diff_path(F.regexp_replace("line", "^" + sign, "")).alias("path")))
    rows = rows.withColumn("path", F.last(mark, ignorenulls=True).over(so_far)["path"])
    p = "^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@"
    count = F.regexp_extract("line", p, group + 1)
    rows = rows.filter(F.col("line").rlike(p) & F.col("path").isNotNull())
    rows = rows.select("commit", "path", F.regexp_extract("line", p, group).cast("int").alias("start"), F.when(count == "", 1).otherwise(count.try_cast("int")).alias("raw_count"))
    out = rows.withColumn("end", F.col("start") + F.greatest(F.col("raw_count") - 1, F.lit(0)))
    return out if keep_empty else out.filter("raw_count > 0")


def pull_requests(texts: DataFrame) -> DataFrame:
    """``number, base, head, merge`` of pull request lists; those without a base or head are dropped."""
    kind = "array<struct<number:int,baseRefOid:string,headRefOid:string,mergeCommit:struct<oid:string>>>"
    p = texts.select(F.explode(F.from_json("text", kind)).alias("p"))
    rows = p.select("p.number", F.col("p.baseRefOid").alias("base"), F.col("p.headRefOid").alias("head"), F.col("p.mergeCommit.oid").alias("merge"))
    return rows.filter("number is not null and base <> '' and head <> ''")


def readable_coverage(texts: DataFrame) -> DataFrame:
    """The reports (``report, text``) that hold an object ``files``; others, missing or corrupt ones, are skipped."""
    return texts.filter(F.coalesce(F.get_json_object("text", "$.files").rlike("^\\s*\\{"), F.lit(False)))


def log_commits(texts: DataFrame) -> DataFrame:
    """``commit, ts, text`` of log records (``value``): a line of hash and epoch seconds, then the diff without context."""
    p = "^\\s*([0-9a-f]{7,64}) (\\d+)\\s*(?:\\n|$)"
    rows = texts.filter(F.col("value").rlike(p))
    ts = F.timestamp_seconds(F.regexp_extract("value", p, 2).try_cast("bigint"))
    return rows.select(F.regexp_extract("value", p, 1).alias("commit"), ts.alias("ts"), F.regexp_replace("value", p, "").alias("text"))


def log_hunks(texts: DataFrame) -> DataFrame:
    """``commit, ts, path, start, end`` of log records."""
    c = log_commits(texts)
    return hunks(c.select("commit", "text")).join(c.select("commit", "ts").distinct(), "commit").select("commit", "ts", "path", "start", "end")


def blame(texts: DataFrame) -> DataFrame:
    """``key, introducer, line`` of porcelain blame output (``key, text``)."""
    rows = texts.select("key", F.explode(F.split("text", "\n")).alias("line"))
    p = "^([0-9a-f]{40}) (\\d+) \\d+"
    return rows.filter(F.col("line").rlike(p)).select("key", F.regexp_extract("line", p, 1).alias("introducer"), F.regexp_extract("line", p, 2).cast("int").alias("at")).withColumnRenamed("at", "line")
