"""One query per operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.functions import names, scoring
from hazardlens.operators import calibration, churn, coverage, graph, history, ladder, model, report, statistics
from hazardlens.plans import views
from hazardlens.plans.views import LC, LINES, SNAPSHOTS, UNITS, Tables, facts_sql, scored_sql
from hazardlens.sources import lcov

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def count(x: str) -> str:
    return f"count(case when {x} then 1 end)::bigint"


# scans, projections, filters


@query(f"with {UNITS} select path, qualname from u where regexp_matches(path, '^Brand#[123].*/.*\\.py$') and not starts_with(path, 'Brand#13/')")
def scan_units_filter(t: Tables) -> DataFrame:
    path = F.col("path")
    return t.units().filter(names.any_glob(path, ["Brand#[123]*/*.py"]) & ~names.any_glob(path, ["Brand#13/*"])).select("path", "qualname")


@query(f"with {LC} select unit, n_measured, n_executed, line_coverage from lc")
def line_coverage(t: Tables) -> DataFrame:
    return coverage.line_coverage(t.units(), t.lines()).select("unit", "n_measured", "n_executed", "line_coverage")


@query(f"with {LC} select unit, n_measured, n_executed, line_coverage from lc")
def line_coverage_binned(t: Tables) -> DataFrame:
    each = coverage.contained(t.units(), t.lines(), "line", bin_size=16).groupBy("unit", "line").agg(F.bool_or("executed").alias("e"))
    n, hit = F.count("*"), F.count_if(F.col("e"))
    return each.groupBy("unit").agg(n.alias("n_measured"), hit.alias("n_executed"), (hit / n).alias("line_coverage"))


@query(f"with {LC} select unit, n_arcs, n_taken, branch_coverage from bc")
def branch_coverage(t: Tables) -> DataFrame:
    return coverage.branch_coverage(t.units(), t.arcs()).select("unit", "n_arcs", "n_taken", "branch_coverage")


for _policy in coverage.POLICIES:
    query(f"with {facts_sql(_policy)} select unit, line_coverage, branch_coverage from facts", f"coverage_policy_{_policy}")(
        lambda t, p=_policy: coverage.with_coverage(t.units(), t.lines(), t.arcs(), t.lines().select("path"), p).select("unit", "line_coverage", "branch_coverage")
    )


@query(f"with {LINES} select unit, string_agg(line::varchar, ',' order by line) as missing from u join lines on u.path = lines.path and line between start_line and end_line where not executed group by unit")
def missing_lines_array(t: Tables) -> DataFrame:
    out = coverage.line_coverage(t.units(), t.lines()).filter(F.size("missing_lines") > 0)
    return out.select("unit", coverage.joined_ints(F.col("missing_lines")).alias("missing"))


@query(f"with {LINES} select unit, string_agg(concat(src::varchar, '>', dst::varchar), ',' order by pos, src, dst) as missing from u join arcs on u.path = arcs.path and src between start_line and end_line where not executed group by unit")
def missing_branches_array(t: Tables) -> DataFrame:
    out = coverage.branch_coverage(t.units(), t.arcs()).filter(F.size("missing_branches") > 0)
    one = lambda x: F.concat(x["src"].cast("string"), F.lit(">"), x["dst"].cast("string"))
    return out.select("unit", F.array_join(F.transform("missing_branches", one), ",").alias("missing"))


@query(f"with {scored_sql()} select unit, {', '.join(scoring.COMPONENTS)} from scored")
def score_components(t: Tables) -> DataFrame:
    return t.scored().select("unit", *scoring.COMPONENTS)


@query(f"with {scored_sql()} select unit, score, severity from scored")
def total_risk(t: Tables) -> DataFrame:
    return t.scored().select("unit", "score", "severity")


CUSTOM = scoring.resolve_weights({"churn": 0.3, "sprawl": 0.0})


@query(f"with {scored_sql(weights=CUSTOM)} select unit, score from scored")
def custom_weights(t: Tables) -> DataFrame:
    return t.scored(weights=CUSTOM).select("unit", "score")


COVERAGE_FREE = scoring.resolve_weights({"coverage_gap": 0.0, "branch_gap": 0.0})


@query(f"with {scored_sql(weights=COVERAGE_FREE)} select unit, score from scored")
def coverage_free_score(t: Tables) -> DataFrame:
    return t.scored(weights=COVERAGE_FREE).select("unit", "score")


@query(f"with {scored_sql()} select unit, crap from scored")
def crap(t: Tables) -> DataFrame:
    return t.scored().select("unit", "crap")


SEVERITY_COUNTS = ", ".join(f"{count(f"severity = '{s}'")} as {s}" for s in report.SEVERITIES)


@query(f"with {scored_sql()} select {SEVERITY_COUNTS} from scored")
def severity_hist(t: Tables) -> DataFrame:
    return report.severity_histogram(t.scored())


GROUPED = ", grps(name, prefix) as (values {}), grouped as (select u.path, max(struct_pack(n := length(prefix), name := name)).name as grp from (select distinct path from u) u left join grps on prefix = '.' or u.path = prefix or starts_with(u.path, concat(prefix, '/')) group by u.path)".format(
    ", ".join(str(g) for g in views.GROUPS)
)


@query(f"with {UNITS}{GROUPED} select path, grp from grouped")
def longest_prefix_groups(t: Tables) -> DataFrame:
    return coverage.longest_prefix(t.units(), t.groups(), "grp")


@query(f"with {scored_sql()}{GROUPED} select coalesce(grp, 'ungrouped') as \"group\", count(*)::bigint as functions, max(score) as max_score, {SEVERITY_COUNTS} from scored join grouped using (path) group by 1")
def group_rollup(t: Tables) -> DataFrame:
    s = t.scored()
    return report.group_rollup(s.join(coverage.longest_prefix(s, t.groups()), "path"))


@query(f"with {scored_sql()} select path, qualname, score from scored order by score desc, concat(path, '::', qualname) limit 20")
def top_risk(t: Tables) -> DataFrame:
    return report.top(t.scored().select("path", "qualname", "score"))


@query(f"with {scored_sql()} select path, qualname, score from scored where score >= 60 order by score desc, concat(path, '::', qualname) limit 50")
def top_min_score(t: Tables) -> DataFrame:
    return report.top(t.scored().select("path", "qualname", "score"), 50, 60.0)


@query(f"with {UNITS} select unit from u where not (starts_with(path, 'Brand#2') and contains(path, '/') or contains(qualname, 'red'))")
def allow_suppress(t: Tables) -> DataFrame:
    return report.suppressed(t.units(), ["Brand#2*/*", "*red*"])[0].select("unit")


@query(f"with {scored_sql()} select unit, score from scored where score > 50")
def scan_gate(t: Tables) -> DataFrame:
    return report.above(t.scored(), 50.0).select("unit", "score")


@query(f"with {scored_sql()} select unit, severity from scored where severity in ('critical', 'high')")
def severity_gate(t: Tables) -> DataFrame:
    return report.at_or_above(t.scored(), "high").select("unit", "severity")


@query(f"with {scored_sql()} select count(*)::bigint as analyzed, {count("not contains(qualname, 'red')")} as emitted, {count("contains(qualname, 'red')")} as suppressed, {', '.join(f"{count(f"severity = '{s}' and not contains(qualname, 'red')")} as {s}" for s in report.SEVERITIES)} from scored")
def run_summary(t: Tables) -> DataFrame:
    return report.run_summary(*report.suppressed(t.scored(), ["*red*"]))


# churn


@query(f"with {LC} select unit, commits from ch")
def function_churn(t: Tables) -> DataFrame:
    return churn.function_churn(t.units(), t.hunks())


@query(f"with {LC} select unit, commits from ch")
def function_churn_binned(t: Tables) -> DataFrame:
    return churn.function_churn(t.units(), t.hunks(), churn.BIN)


@query(f"with {LINES} select path, count(distinct commit)::bigint as commits from everhunks group by path")
def file_churn(t: Tables) -> DataFrame:
    return churn.file_churn(t.hunks(all_time=True))


@query(f"with {LINES} select unit, count(distinct commit)::bigint as commits, sum(end_ - start_ + 1)::bigint as lines from u join everhunks h on u.path = h.path and start_ <= end_line and start_line <= end_ group by unit")
def change_counts(t: Tables) -> DataFrame:
    return churn.change_counts(t.units(), t.hunks(all_time=True))


NESTED = UNITS + ", nested as (select unit, path, start_line, end_line, ordinal from u union all select unit + 10000000, path, greatest(start_line - 40, 1), end_line + 40, ordinal - 100 from u)"


@query(f"with {NESTED}, pts as (select distinct path, line from touched) select pts.path, line, arg_min(unit, ordinal) as unit from pts left join nested on nested.path = pts.path and line between start_line and end_line group by 1, 2")
def enclosing_first(t: Tables) -> DataFrame:
    u = t.units().select("unit", "path", "start_line", "end_line", "ordinal")
    outer = u.select((F.col("unit") + 10_000_000).alias("unit"), "path", F.greatest(F.col("start_line") - 40, F.lit(1)).alias("start_line"), (F.col("end_line") + 40).alias("end_line"), (F.col("ordinal") - 100).alias("ordinal"))
    return coverage.first_enclosing(u.unionByName(outer), t.touched().select("path", "line").distinct()).select("path", "line", "unit")


# lookups


def _records(t: Tables) -> DataFrame:
    u = t.units().select("path").distinct()
    a = u.select(F.concat(F.lit("/repo/"), F.col("path")).alias("record"), F.lit(2).alias("ordinal"))
    b = u.select(F.concat(F.lit("/build/long/repo/"), F.col("path")).alias("record"), F.lit(1).alias("ordinal"))
    return a.unionByName(b)


RECORDS = UNITS + ", paths as (select distinct path from u), recs as (select concat('/repo/', path) as record, 2 as ordinal from paths union all select concat('/build/long/repo/', path), 1 from paths), hits as (select paths.path, record, ordinal from paths join recs on ends_with(record, concat('/', paths.path)))"


@query(f"with {RECORDS} select path, arg_min(record, ordinal) as record from hits group by path")
def suffix_lookup_first(t: Tables) -> DataFrame:
    return coverage.suffix_lookup(t.units(), _records(t).withColumn("ordinal", F.col("ordinal")), "first")


@query(f"with {RECORDS} select path, arg_max(record, length(record)) as record from hits group by path")
def suffix_lookup_longest(t: Tables) -> DataFrame:
    return coverage.suffix_lookup(t.units(), _records(t), "longest")


SHARDS = (("", "all"), ("Brand#1", "one"), ("./Brand#2/", "two"))


@query(f"with {UNITS}, paths as (select distinct path from u) select path, case when starts_with(path, 'Brand#1/') and hash_ok then 'Brand#1' else '' end as prefix, path as record from (select path, length(path) % 2 = 0 as hash_ok from paths)")
def shard_longest_prefix_fallthrough(t: Tables) -> DataFrame:
    spark = t.spark
    shards = spark.createDataFrame([(p,) for p, _ in SHARDS], "prefix string")
    u = t.units().select("path").distinct()
    under_one = u.filter(F.startswith("path", F.lit("Brand#1/")) & (F.length("path") % 2 == 0)).select(F.lit("Brand#1").alias("prefix"), F.col("path").alias("record"))
    return coverage.shard_lookup(u, shards, u.select(F.lit("").alias("prefix"), F.col("path").alias("record")).unionByName(under_one))


@query(f"with {LINES}, hit as (select distinct u.path from u join lines on u.path = lines.path and line between start_line and end_line), has as (select distinct path from lines) select distinct u.path, has.path is null or hit.path is not null as aligned from u left join has using (path) left join hit using (path)")
def alignment_semi(t: Tables) -> DataFrame:
    return coverage.aligned(t.units(), t.lines())


@query(f"with {LINES}, e as (select unit, line, max(l_linenumber - 1) as hits from u join touched on u.path = touched.path and line between start_line and end_line group by unit, line) select unit, count(*)::bigint as n_lines, {count('hits > 0')} as n_hit, {count('hits > 0')}::double / count(*) as line_coverage from e group by unit")
def ts_line_max_hits(t: Tables) -> DataFrame:
    return coverage.statement_lines(t.units(), t.touched().select("path", "line", (F.col("l_linenumber") - 1).alias("hits")))


@query(f"with {LINES} select unit, 2 * count(*)::bigint as n_arms, (count(case when l_linestatus = 'F' then 1 end) + count(case when l_returnflag = 'R' then 1 end))::bigint as n_taken from u join touched on u.path = touched.path and line between start_line and end_line group by unit")
def branch_arms(t: Tables) -> DataFrame:
    arms = F.array((F.col("l_linestatus") == "F").cast("int"), (F.col("l_returnflag") == "R").cast("int"))
    b = t.touched().select("path", F.col("l_orderkey").alias("ordinal"), "line", arms.alias("arms"))
    return coverage.branch_arms(t.units(), b).select("unit", "n_arms", "n_taken")


# baselines


@query("select source as path, lang as qualname, arg_max(n_chars, doc_id) as score from documents group by 1, 2")
def baseline_latest_dup(t: Tables) -> DataFrame:
    d = t("documents").select(F.col("source").alias("path"), F.col("lang").alias("qualname"), F.col("n_chars").alias("score"), F.col("doc_id").alias("ordinal"))
    return coverage.latest(d, ["path", "qualname"]).select("path", "qualname", "score")


@query(f"with {SNAPSHOTS} select path, qualname from ex")
def ladder_exact(t: Tables) -> DataFrame:
    return ladder.exact(t.snapshot(True), t.snapshot(False)).select("path", "qualname")


@query(f"with {SNAPSHOTS} select path, qualname, old_path, old_qualname from fp")
def ladder_fingerprint(t: Tables) -> DataFrame:
    return ladder.by_fingerprint(t.snapshot(True), t.snapshot(False)).select("path", "qualname", "old_path", "old_qualname")


@query(f"with {SNAPSHOTS} select path, qualname, old_path, old_qualname, similarity, best >= 0.65::double and best - similarity <= 0.05::double as near_top from cand")
def rename_candidates(t: Tables) -> DataFrame:
    return ladder.rename_candidates(t.snapshot(True), t.snapshot(False)).select("path", "qualname", "old_path", "old_qualname", "similarity", "near_top")


@query(f"with {SNAPSHOTS} select path, qualname, count(*)::bigint as near from cand where best >= 0.65::double and best - similarity <= 0.05::double group by 1, 2 having count(*) > 1")
def rename_ambiguous(t: Tables) -> DataFrame:
    c = ladder.rename_candidates(t.snapshot(True), t.snapshot(False)).filter("near_top")
    return c.groupBy("path", "qualname").agg(F.count("*").alias("near")).filter("near > 1")


@query()
def diff_full(t: Tables) -> DataFrame:
    return ladder.diff(t.snapshot(True), t.snapshot(False))


@query()
def diff_rollup(t: Tables) -> DataFrame:
    return report.status_rollup(ladder.diff(t.snapshot(True), t.snapshot(False)))


@query()
def regressions(t: Tables) -> DataFrame:
    return ladder.regressions(ladder.diff(t.snapshot(True), t.snapshot(False)), existing_above=90.0)


@query()
def compare_gate(t: Tables) -> DataFrame:
    return ladder.compare(t.snapshot(True), t.snapshot(False), existing_above=90.0)


EXACT_PAIRS = SNAPSHOTS + ", pairs as (select n.path, n.qualname, n.score - o.score as delta, n.structural_complexity - o.structural_complexity as grown, o.structural_complexity as before, n.structural_complexity as after from n join o using (path, qualname))"


@query(f"with {EXACT_PAIRS} select path, qualname, delta, case when delta > 5 then 'regressed' when delta < -5 then 'improved' when grown > 15 then 'component_regressed' else 'unchanged' end as status from pairs")
def diff_exact_status(t: Tables) -> DataFrame:
    new, old = t.snapshot(True), t.snapshot(False)
    d = ladder.diff(new, old).filter("previous_path is null and previous_score is not null and current_score is not null")
    return d.select("path", "qualname", "delta", "status")


@query(f"with {EXACT_PAIRS} select path, qualname, 'structural_complexity' as component, before, after, grown from pairs where grown > 15")
def component_argmax(t: Tables) -> DataFrame:
    n, o = t.snapshot(True), t.snapshot(False)
    j = n.join(o.select("path", "qualname", *[F.col(c).alias(f"old_{c}") for c in scoring.COMPONENTS]), ["path", "qualname"])
    best = scoring.argmax_growth({c: F.col(c) for c in scoring.COMPONENTS}, {c: F.col(f"old_{c}") for c in scoring.COMPONENTS}, 15.0)
    j = j.select("path", "qualname", best.alias("b")).filter("b is not null")
    return j.select("path", "qualname", F.col("b.name").alias("component"), "b.before", "b.after", F.col("b.delta").alias("grown"))


@query(f"with {SNAPSHOTS} select path, qualname, score from lo")
def removed(t: Tables) -> DataFrame:
    n, o = t.snapshot(True), t.snapshot(False)
    used = ladder.by_fingerprint(n, o).select(F.col("old_path").alias("path"), F.col("old_qualname").alias("qualname"))
    return ladder.removed(o, n, used).select("path", "qualname", "score")


@query(f"with {SNAPSHOTS} select {count('n.path is not null and o.path is not null and round(n.score, 6) is distinct from round(o.score, 6)')} as changed, {count('n.path is null')} as removed, {count('o.path is null')} as added from n full join o on n.path = o.path and n.qualname = o.qualname")
def score_drift(t: Tables) -> DataFrame:
    return ladder.score_drift(t.snapshot(False), t.snapshot(True))


# statistics

LABELLED = "d as (select doc_id, lang, n_chars, toxic, quality from documents join labels using (doc_id))"
RANKS = LABELLED + ", r as (select *, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0::double as rx, rank() over (order by doc_id % 50) + (count(*) over (partition by doc_id % 50) - 1) / 2.0::double as ry from d)"


def _labelled(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id")


@query(f"with {RANKS} select doc_id, rx::double as rank from r")
def avg_rank(t: Tables) -> DataFrame:
    return statistics.average_rank(_labelled(t), "n_chars").select("doc_id", "rank")


@query(f"with {LABELLED} select round(corr(n_chars::double, (doc_id % 50)::double), 9) as pearson from d")
def pearson(t: Tables) -> DataFrame:
    d = _labelled(t).withColumn("y", F.col("doc_id") % 50)
    return statistics.pearson(d, "n_chars", "y").select(F.round("pearson", 9).alias("pearson"))


@query(f"with {RANKS} select round(corr(rx::double, ry::double), 9) as spearman from r")
def spearman(t: Tables) -> DataFrame:
    d = _labelled(t).withColumn("y", F.col("doc_id") % 50)
    return statistics.spearman(d, "n_chars", "y").select(F.round("spearman", 9).alias("spearman"))


def _mw(by: str) -> str:
    part = f"partition by {by} " if by else ""
    own = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""with {LABELLED}, r as (select *, rank() over ({part}order by n_chars) + (count(*) over (partition by {own}n_chars) - 1) / 2.0::double as rk, count(*) over (partition by {own}n_chars) as t from d),
s as (select {own}sum(case when toxic = 1 then 1 else 0 end)::double as n1, sum(case when toxic = 1 then 0 else 1 end)::double as n0, sum(case when toxic = 1 then rk::double else 0 end) as r1, sum((t * t - 1)::double) as ties from r {group}),
z as (select *, r1 - n1 * (n1 + 1) / 2 as u, n1 + n0 as n from s)
select {own}n1::bigint as n1, n0::bigint as n0, u, round(2 * u / nullif(n1 * n0, 0) - 1, 9) as effect, round((2 * u / nullif(n1 * n0, 0) - 1 + 1) / 2, 9) as auc,
  round((u - n1 * n0 / 2) / nullif(sqrt(n1 * n0 / 12 * ((n + 1) - ties / nullif(n * (n - 1), 0))), 0), 9) as z from z"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("effect", "auc", "z")})


@query(_mw(""))
def mann_whitney(t: Tables) -> DataFrame:
    return _rounded(statistics.mann_whitney(_labelled(t).withColumn("p", F.col("toxic") == 1), "n_chars", "p"))


@query(_mw("lang"))
def auc(t: Tables) -> DataFrame:
    return _rounded(statistics.mann_whitney(_labelled(t).withColumn("p", F.col("toxic") == 1), "n_chars", "p", ["lang"]))


@query(f"with {LABELLED} select lang, count(*)::bigint as n, min(n_chars)::double as least, max(n_chars)::double as most, {', '.join(f'{count(f"least(9, greatest(0, floor(n_chars / 1000.0)))::int = {i}")} as bin{i}' for i in range(10))} from d group by lang")
def distribution_hist(t: Tables) -> DataFrame:
    d = _labelled(t).withColumn("v", F.col("n_chars") / 100.0)
    out = statistics.distribution(d, "v", ["lang"])
    scale = {c: F.round(F.col(c) * 100, 0) for c in ("least", "most")}
    return out.withColumns(scale).select("lang", "n", "least", "most", *[f"bin{i}" for i in range(10)])


AT = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query(f"with {LABELLED} select lang, count(*)::bigint as n, {', '.join(f'round(quantile_cont(n_chars::double, {p}), 6) as {k}' for k, p in AT.items())} from d group by lang")
def linear_quantiles(t: Tables) -> DataFrame:
    out = statistics.quantiles(_labelled(t), "n_chars", AT, ["lang"])
    return out.select("lang", "n", *[F.round(k, 6).alias(k) for k in AT])


def _interpolated(p: str) -> str:
    at = f"({p} * (n - 1))"
    return f"(l[floor{at}::int + 1] + ({at} - floor{at}) * (l[ceil{at}::int + 1] - l[floor{at}::int + 1]))"


BAND = f"""with s as (select p_size % 25 + 1 as v from part), q as (select avg((v <= 2)::int::double) as p_free, avg((v <= 21)::int::double) as p_full from s),
l as (select list((p_size % 40 + 1)::double order by p_size % 40 + 1) as l, count(*) as n from part),
r as (select p_free, p_full, {_interpolated('p_free')} as a, {_interpolated('p_full')} as b from q, l)
select round(p_free, 9) as p_free, round(p_full, 9) as p_full, greatest(1::double, round_even(a, 0)) as free, greatest(greatest(1::double, round_even(a, 0)) + 1, round_even(b, 0)) as "full" from r"""


@query(BAND)
def percentile_band(t: Tables) -> DataFrame:
    p = t("part")
    out = statistics.matched_band(p.select((F.col("p_size") % 25 + 1).alias("v")), p.select((F.col("p_size") % 40 + 1).alias("v")), "v", 2, 21)
    return out.select(F.round("p_free", 9).alias("p_free"), F.round("p_full", 9).alias("p_full"), "free", "full")


EVENTS = "a as (select user_id, event_type, count(*)::bigint as commits, sum(round(value)::bigint)::bigint as lines from events group by 1, 2)"


def _activity(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("commits"), F.sum(F.round("value").cast("long")).alias("lines"))


@query(f"with {EVENTS} select user_id, event_type from (select *, row_number() over (partition by user_id order by commits desc, lines desc, event_type) as k, count(*) over (partition by user_id) as n from a) where k <= ceil(0.25 * n) and commits > 0")
def top_quartile(t: Tables) -> DataFrame:
    order = [F.desc("commits"), F.desc("lines"), F.asc("event_type")]
    return statistics.top_quantile(_activity(t), "user_id", order).filter("chosen").select("user_id", "event_type")


@query(f"with m as ({_mw('lang')}) select round(avg(auc), 6) as mean_auc, round(sum(auc * (n1 + n0)) / nullif(sum(n1 + n0), 0), 6) as weighted_auc from m")
def weighted_auc(t: Tables) -> DataFrame:
    m = _rounded(statistics.mann_whitney(_labelled(t).withColumn("p", F.col("toxic") == 1), "n_chars", "p", ["lang"]))
    out = calibration.mean_auc(m.withColumn("n", F.col("n1") + F.col("n0")))
    return out.select(F.round("mean_auc", 6).alias("mean_auc"), F.round("weighted_auc", 6).alias("weighted_auc"))


@query(f"with {LABELLED}, t(tier) as (values ('low'), ('high')) select tier, count(doc_id)::bigint as n, round(avg(n_chars), 6) as mean from t left join d on (tier = 'high') = (quality = 1) group by tier")
def tier_gradient(t: Tables) -> DataFrame:
    d = _labelled(t).withColumn("tier", F.when(F.col("quality") == 1, "high").otherwise("low"))
    return calibration.tier_gradient(d, "tier", "n_chars", ["low", "high"]).withColumn("mean", F.round("mean", 6))


@query(f"with {LABELLED}, s as (select avg(n_chars) as m, stddev_pop(n_chars) as s from d) select doc_id, round((n_chars - m) / case when s > 0 then s else 1 end, 6) as x from d, s")
def standardize(t: Tables) -> DataFrame:
    d = _labelled(t).select("doc_id", F.col("n_chars").cast("double").alias("x"))
    return statistics.standardized(d, ["x"]).select("doc_id", F.round("x", 6).alias("x"))


# candidate formulas: file-length share of sprawl, by weight and band
CANDIDATES = (("drop", 1.0, 0.0, 500.0, 1000.0), ("blend", 0.5, 0.5, 500.0, 1000.0), ("shrink60", 0.6, 0.4, 500.0, 1000.0), ("shrink75", 0.75, 0.25, 500.0, 1000.0), ("shrink90", 0.9, 0.1, 500.0, 1000.0), ("band750", 0.5, 0.5, 750.0, 1500.0), ("band1000", 0.5, 0.5, 1000.0, 2000.0), ("band1500", 0.5, 0.5, 1500.0, 3000.0))
CANDIDATE_SQL = "cands(key, fw, tw, a, b) as (values " + ", ".join(f"('{k}', {f}::double, {w}::double, {a}::double, {b}::double)" for k, f, w, a, b in CANDIDATES) + ")"


@query(f"with {UNITS}, {CANDIDATE_SQL}, f as (select *, sum(n_lines) over (partition by path)::double as total from u) select unit, key, fw * (case when n_lines <= 80 then 0::double when n_lines >= 160 then 100::double else (n_lines - 80::double) / 80::double * 100::double end) + tw * (case when total <= a then 0::double when total >= b then 100::double else (total - a) / (b - a) * 100::double end) as sprawl from f, cands")
def candidate_sprawl(t: Tables) -> DataFrame:
    return model.candidate_sprawl(t.units(), t.spark.createDataFrame(list(CANDIDATES), "key string, fw double, tw double, a double, b double")).select("unit", "key", "sprawl")


@query(f"with {UNITS}, {CANDIDATE_SQL}, f as (select *, sum(n_lines) over (partition by path)::double as total from u), sp as (select unit, key, fw * (case when n_lines <= 80 then 0::double when n_lines >= 160 then 100::double else (n_lines - 80::double) / 80::double * 100::double end) + tw * (case when total <= a then 0::double when total >= b then 100::double else (total - a) / (b - a) * 100::double end) as v, unit % 4 = 0 as y from f, cands), r as (select *, rank() over (partition by key order by v) + (count(*) over (partition by key, v) - 1) / 2.0::double as rk from sp) select key, round((sum(case when y then rk::double else 0 end) - {count('y')} * ({count('y')} + 1) / 2.0::double) / nullif({count('y')}::double * {count('not y')}, 0), 9) as auc from r group by key")
def candidate_auc(t: Tables) -> DataFrame:
    s = model.candidate_sprawl(t.units(), t.spark.createDataFrame(list(CANDIDATES), "key string, fw double, tw double, a double, b double"))
    out = statistics.mann_whitney(s.withColumn("y", F.col("unit") % 4 == 0), "sprawl", "y", ["key"])
    return out.select("key", F.round("auc", 9).alias("auc"))


# text, JSON, history


@query("select page_id, substr(sha256(concat('salt', url)), 1, 12) as redacted from pages")
def redact_ids(t: Tables) -> DataFrame:
    return t("pages").select("page_id", names.redacted(F.col("url"), "salt").alias("redacted"))


KEYWORDS = "fix|bug|close|resolve|hotfix"


@query(f"select conv_id, turn from conversations where regexp_matches(lower(text), '(^|[^a-z0-9_à-ÿ])({KEYWORDS}|the)')")
def fix_keyword(t: Tables) -> DataFrame:
    return t("conversations").filter(history.has_keyword(F.lower("text"), [*KEYWORDS.split("|"), "the"])).select("conv_id", "turn")


@query(r"select doc_id, array_to_string(regexp_extract_all(text, '#([0-9]+)', 1), ',') as issues from documents where regexp_matches(text, '#[0-9]')")
def issue_numbers(t: Tables) -> DataFrame:
    return t("documents").filter(F.col("text").rlike("#[0-9]")).select("doc_id", F.array_join(history.issue_numbers(F.col("text")), ",").alias("issues"))


@query("select conv_id, turn from conversations where regexp_matches(lower(text), '(too (long|complex)|hard to (read|follow)|refactor|simplif|the (and|of))')")
def review_phrase(t: Tables) -> DataFrame:
    return t("conversations").filter(F.lower("text").rlike("too (long|complex)|hard to (read|follow)|refactor|simplif|the (and|of)")).select("conv_id", "turn")


@query("select event_id, (props::json->>'$.k')::int as k from events")
def json_props(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


LCOV_TEXT = "TN:\nSF:src/a.ts\nFN:1,f\nFNDA:2,f\nDA:1,2\nDA:2,0\nDA:x\nBRDA:2,0,0,1\nBRDA:2,0,1,-\nend_of_record\nSF:src/b.ts\nDA:bad\nend_of_record\nSF:src/a.ts\nDA:5,1\n"


@query("select * from (values ('src/a.ts', 5::bigint, 1::bigint)) as t(path, line, hits)")
def lcov_parse(t: Tables) -> DataFrame:
    texts = t.spark.createDataFrame([("cov.info", LCOV_TEXT)], "report string, text string")
    return lcov.statements(lcov.records(texts)).select("path", "line", "hits")


EDGES = "e as (select o_custkey as a, o_orderkey % (select count(*) from customer) + 1 as b from orders where o_orderkey % 5 = 0)"


@query(f"with recursive {EDGES}, r(node, depth) as (select c_custkey, 0 from customer where c_custkey % 200 = 1 union select e.b, depth + 1 from r join e on e.a = r.node where depth < 6) select distinct node from r")
def export_reachability(t: Tables) -> DataFrame:
    n = t("customer").count()
    edges = t("orders").filter(F.col("o_orderkey") % 5 == 0).select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % n + 1).alias("b"))
    roots = t("customer").filter(F.col("c_custkey") % 200 == 1).select(F.col("c_custkey").alias("node"))
    return graph.reachable(edges, roots, depth=6)


@query()
def export_closure(t: Tables) -> DataFrame:
    """All that every order's edge reaches, in any number of steps, from the customers of the first nation."""
    n = t("customer").count()
    edges = t("orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % n + 1).alias("b"))
    roots = t("customer").filter(F.col("c_nationkey") == 0).select(F.col("c_custkey").alias("node"))
    return graph.reachable(edges, roots)


@query("with l as (select doc_id % 7 as repo, doc_id as pr, doc_id % 3 as base, quality as label from labels), r as (select doc_id % 7 as repo, doc_id as pr, doc_id % 2 as base from documents), same as (select distinct repo, pr from l) select r.repo, r.pr, coalesce(l.label::varchar, 'unlabeled') as label, l.label is null and same.pr is not null as stale from r left join l on l.repo = r.repo and l.pr = r.pr and l.base = r.base left join same on same.repo = r.repo and same.pr = r.pr")
def label_join_stale(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    labels = t("labels").select((key % 7).alias("repo"), key.alias("pr"), (key % 3).alias("base"), F.col("quality").cast("string").alias("label"))
    runs = t("documents").select((key % 7).alias("repo"), key.alias("pr"), (key % 2).alias("base"))
    return history.labelled_runs(runs, labels, ["repo", "pr"], ["base"]).select("repo", "pr", "label", "stale")


@query(r"with q as (select doc_id, concat(lang, case when doc_id % 3 = 0 then '._hidden' when doc_id % 3 = 1 then '.__init__' else '.f' end, case when doc_id % 5 = 0 then '.____' else '' end) as q from documents) select doc_id, doc_id % 3 <> 0 and doc_id % 5 <> 0 as public from q")
def private_segments(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    q = F.concat("lang", F.when(i % 3 == 0, "._hidden").when(i % 3 == 1, ".__init__").otherwise(".f"), F.when(i % 5 == 0, ".____").otherwise(""))
    return t("documents").select("doc_id", names.is_public(q).alias("public"))


@query("select user_id, " + ", ".join(f"{count(f"event_type = '{e}'")} as {e}" for e in ("view", "click", "purchase", "never")) + " from events group by user_id")
def zero_fill_pivot(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id").agg(*report.counts_by("event_type", ("view", "click", "purchase", "never")))


@query("with s as (select vec_id, list_transform(embedding[1:6], lambda x: x::double) as v from embeddings) select a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) as cosine from s a join s b on b.vec_id = a.vec_id + 1")
def component_cosine(t: Tables) -> DataFrame:
    at = lambda side: [F.get(F.col(side), F.lit(i)).cast("double") for i in range(6)]
    e = t("embeddings").select("vec_id", F.col("embedding").alias("a"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return j.select("vec_id", F.round(ladder.cosine(at("a"), at("b")), 6).alias("cosine"))


# models (no SQL form)


@query()
def logit_loro(t: Tables) -> DataFrame:
    return model.leave_one_out(_features(t), ["x1", "x2", "x3"])


@query()
def bootstrap_ci(t: Tables) -> DataFrame:
    return model.bootstrap_interval(_features(t), ["x1", "x2", "x3"], "x1")


def _features(t: Tables) -> DataFrame:
    d = _labelled(t)
    words = F.size(F.split("text", " "))
    d = d.join(t("documents").select("doc_id", words.alias("w"), F.col("source").alias("repo")), "doc_id")
    return d.select("repo", F.col("doc_id").cast("string").alias("target"), F.log1p("n_chars").alias("x1"), (F.col("n_chars") / F.col("w")).alias("x2"), (F.col("doc_id") % 11).cast("double").alias("x3"), F.col("quality").alias("label"))


@query()
def parse_python(t: Tables) -> DataFrame:
    from hazardlens.sources import python_files

    files = t.spark.createDataFrame([("src/a.py", python_files.EXAMPLE.encode()), ("src/bad.py", b"def ("), ("src/empty.py", b"")], "path string, content binary")
    return python_files.functions(python_files.parsed(files))


from hazardlens.plans import calibration_queries  # noqa: E402, F401  (registers its queries)
