"""History mining on tables: fix commits, defect and change labels, review flags, run outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardlens.functions.names import tail
from hazardlens.functions.scoring import COMPONENTS
from hazardlens.operators import coverage, ladder, statistics

# Words that mark a fix.
FIX_WORDS = ("fix", "bug", "close", "resolve", "hotfix")


def has_keyword(text: Column, words: Sequence[str] = FIX_WORDS) -> Column:
    """Whether a word of ``text`` begins with one of ``words``, in either case."""
    return text.rlike("(?iU)\\b(?:" + "|".join(words) + ")")


def issue_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("#([0-9]+)"), F.lit(1))


def fix_commits(log: DataFrame, words: Sequence[str] = FIX_WORDS, most: int | None = None) -> DataFrame:
    """Fixes among log lines (``line``: hash, parents and subject, separated by zero characters); other lines are dropped."""
    f = F.split("line", "\\x00")
    rows = log.filter(F.size(f) == 3).select(f[0].alias("sha"), f[1].alias("parents"), f[2].alias("subject"))
    rows = rows.filter(has_keyword(F.col("subject"), words))
    rows = rows.withColumn("issues", F.transform(issue_numbers(F.col("subject")), lambda x: x.cast("int")))
    rows = rows.withColumn("is_merge", F.size(F.filter(F.split("parents", "\\s+"), lambda x: x != "")) > 1)
    return rows if most is None else rows.limit(most)


#: Signals beside the body, by their bit in a mask.
SIGNALS = {"signature": ladder.SIGNATURE, "path": ladder.PATH, "tail": ladder.TAIL}


def _weight(mask: int) -> float:
    return ladder.BODY + sum(w for i, w in enumerate(SIGNALS.values()) if mask >> i & 1)


def _by_signals(df: DataFrame) -> DataFrame:
    """A row for each set of signals that aren't null: its ``mask``, the body and their values (the others empty)."""
    named = df.withColumn("tail", tail(F.col("qualname")))
    keys = []
    for mask in range(1 << len(SIGNALS)):
        own = [c for i, c in enumerate(SIGNALS) if mask >> i & 1]
        key = F.struct(F.lit(mask).alias("mask"), F.col("fingerprint").alias("body"), *[(F.col(c) if c in own else F.lit("")).alias(f"k_{c}") for c in SIGNALS])
        known = F.lit(True)
        for c in own:
            known = known & F.col(c).isNotNull()
        keys.append(F.when(known, key))
    return named.withColumn("key", F.explode(F.array(*keys))).filter("key is not null").select("*", "key.*").drop("key", "tail")


def tracked(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``rows`` (``path, qualname, fingerprint, signature``) plus ``sid``: the snapshot function that each is, or null.

    The same id; else the best by the ladder's similarity (the row counts as all zero), if it is similar enough and no other
    is near it. Without an equal body a pair has 0.45 at most, which neither is enough nor near to what is: bodies decide who
    competes. Copies of a body aren't paired: a row meets the counts of snapshot functions for each set of signals that they
    share with it at least, and inclusion and exclusion give how many are near its best.
    """
    ids = ["path", "qualname", "fingerprint", "signature"]
    wanted = rows.select(*ids).distinct()
    exact = wanted.join(snapshot.select("path", "qualname", F.col("sid").alias("by_id")), ["path", "qualname"])
    open_rows = wanted.join(snapshot.select("path", "qualname"), ["path", "qualname"], "left_anti").filter("fingerprint is not null")
    had = lambda c: F.col(c) if c in snapshot.columns else F.lit(0.0)
    shape, zero = F.lit(True), F.lit(0.0)
    for c in COMPONENTS:
        shape = shape & (had(c) == 0)
    yes = lambda cond, w: F.when(F.coalesce(cond, F.lit(False)), F.lit(w)).otherwise(zero)
    more = yes(shape, ladder.SHAPE) + yes(F.abs(had("score")) <= ladder.SCORE_MOST, ladder.SCORE)
    old = snapshot.select("sid", *ids, more.alias("more")).distinct().join(open_rows.select("fingerprint").distinct(), "fingerprint", "left_semi")
    key = ["mask", "body", *[f"k_{c}" for c in SIGNALS]]
    counts = _by_signals(old).groupBy(*key, "more").agg(F.count("*").alias("n"), F.min("sid").alias("near"))
    met = _by_signals(open_rows).join(counts, key)
    value = lambda mask: F.round(F.lit(_weight(mask)) + F.col("more"), 6)
    masks = range(1 << len(SIGNALS))
    met = met.withColumn("similarity", F.element_at(F.array(*map(value, masks)), F.col("mask") + 1))
    met = met.withColumn("best", F.max("similarity").over(Window.partitionBy(*ids))).filter(F.col("best") >= ladder.MATCH)
    share = F.lit(0)
    for m in masks:
        sign = F.when(F.bit_count(F.col("mask").bitwiseXOR(F.lit(m))) % 2 == 0, 1).otherwise(-1)
        share = share + F.when((F.col("mask").bitwiseAND(F.lit(m)) == m) & (F.col("best") - value(m) <= ladder.BAND), sign).otherwise(0)
    best = met.groupBy(*ids).agg(F.sum(share * F.col("n")).alias("n"), F.max_by("near", "similarity").alias("near")).filter("n = 1").drop("n")
    found = exact.select(*ids, F.col("by_id").alias("sid")).unionByName(best.select(*ids, F.col("near").alias("sid"))).select(*[F.col(c).alias(f"_{c}") for c in ids], "sid")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ids]
    return rows.drop("sid").join(found, same[0] & same[1] & same[2] & same[3], "left").drop(*[f"_{c}" for c in ids])


def defect_labels(fixes: DataFrame, old_hunks: DataFrame, blame: DataFrame, functions_at: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``sid, defects``: distinct fixes that changed lines which each snapshot function introduced.

    A fix's old-side hunks (zero counts dropped, merges excluded) are matched with blame rows (``fix_sha, path, line,
    introducer``), these with the first enclosing function at the fix's parent (``sha`` of ``functions_at``).
    """
    own = fixes.filter(~F.col("is_merge")).select(F.col("sha").alias("fix_sha"))
    h = old_hunks.filter(F.col("raw_count") > 0).join(own, "fix_sha")
    b = h.join(blame, ["fix_sha", "path"]).filter(F.col("line").between(F.col("start"), F.col("end"))).select("fix_sha", "path", "line", "introducer")
    f = functions_at.withColumn("path", F.concat_ws("\0", "sha", "path"))
    at = coverage.first_enclosing(f, b.withColumn("path", F.concat_ws("\0", "fix_sha", "path")))
    named = at.join(functions_at.select("unit", "qualname", "fingerprint", "signature", F.col("path").alias("real_path")), "unit")
    named = tracked(named.withColumn("path", F.col("real_path")), snapshot)
    return named.filter("sid is not null").groupBy("sid").agg(F.countDistinct("fix_sha").alias("defects"))


def change_labels(future: DataFrame, past: DataFrame, part: float = 0.25) -> DataFrame:
    """Future and past change counts of each (``repo, target``), and ``change_prone``: the repo's top quarter by future ones."""
    f = statistics.top_quantile(future, "repo", [F.desc("commits"), F.desc("lines"), F.asc("target")], part)
    f = f.select("repo", "target", F.col("commits").alias("future_commits"), F.col("lines").alias("future_lines"), F.col("chosen").alias("change_prone"))
    p = past.select("repo", "target", F.col("commits").alias("past_commits"), F.col("lines").alias("past_lines"))
    return f.join(p, ["repo", "target"], "full_outer").na.fill(0).na.fill(False)


def review_comments(raw: DataFrame) -> DataFrame:
    """Comments with path, line and commit; ``line`` else ``original_line``, likewise the commit; zero and empty count as missing."""
    line = F.coalesce(F.nullif("line", F.lit(0)), F.nullif("original_line", F.lit(0)))
    commit = F.coalesce(F.nullif("commit_id", F.lit("")), F.nullif("original_commit_id", F.lit("")))
    rows = raw.select("path", line.alias("line"), commit.alias("commit"), "body")
    return rows.filter(F.col("path").isNotNull() & (F.col("path") != "") & F.col("line").isNotNull() & F.col("commit").isNotNull())


def flag_agreement(flags: DataFrame, activity: DataFrame) -> DataFrame:
    """AUC of future commits between flagged functions (0 where inactive) and unflagged active ones."""
    f = flags.select("sid").distinct().join(activity, "sid", "left").select(F.coalesce("commits", F.lit(0)).alias("v"), F.lit(True).alias("flag"))
    u = activity.join(flags.select("sid").distinct(), "sid", "left_anti").select(F.col("commits").alias("v"), F.lit(False).alias("flag"))
    return statistics.mann_whitney(f.unionByName(u), "v", "flag")


def labelled_runs(runs: DataFrame, labels: DataFrame, run: Sequence[str], shas: Sequence[str]) -> DataFrame:
    """``runs`` plus ``label`` (``unlabeled`` without one) and ``stale``: the run has a label, for other commits."""
    out = runs.join(labels, [*run, *shas], "left").join(labels.select(*run).distinct().withColumn("_any", F.lit(True)), list(run), "left")
    return out.withColumn("stale", F.col("label").isNull() & F.col("_any").isNotNull()).withColumn("label", F.coalesce("label", F.lit("unlabeled"))).drop("_any")


def outcome_tally(diffs: DataFrame) -> DataFrame:
    """Per (``repo, pr``): counts by status and the regressed targets, sorted."""
    name = F.concat_ws("::", "path", "qualname")
    return diffs.groupBy("repo", "pr").agg(
        F.count_if(F.col("status") == "regressed").alias("regressed"), F.count_if(F.col("status") == "component_regressed").alias("component_regressed"),
        F.count_if(F.col("status") == "moved").alias("moved"), F.count_if(F.col("status") == "ambiguous_rename").alias("ambiguous"), F.count_if(F.col("status") == "new").alias("new"),
        F.sort_array(F.collect_list(F.when(F.col("status") == "regressed", name))).alias("targets"))
