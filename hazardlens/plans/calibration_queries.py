"""Queries of the calibration operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardlens.functions import names
from hazardlens.functions.scoring import COMPONENTS, WEIGHTS, saturating
from hazardlens.operators import calibration, graph, history, ladder, model, report, statistics
from hazardlens.plans.queries import CANDIDATE_SQL, CANDIDATES, GROUPED, LABELLED, SEVERITY_COUNTS, _features, _labelled, count, query
from hazardlens.plans.views import SNAPSHOTS, UNITS, Tables, facts_sql, scored_sql

KIND_COUNTS = ", ".join(f"{count(f"kind = '{k}'")} as {k}" for k in report.KINDS)
EXACT_KINDS = SNAPSHOTS + """, kinds as (select coalesce(n.grp, 'ungrouped') as g, n.path, n.qualname, n.score, n.score - o.score as delta, case when n.score - o.score > 5 then 'regressed' when n.score - o.score < -5 then null
  when n.structural_complexity - o.structural_complexity > 15 then 'component_regressed' end as kind from n join o using (path, qualname))"""


def _exact_regressions(t: Tables) -> DataFrame:
    diff = ladder.diff(t.snapshot(True), t.snapshot(False))
    return ladder.regressions(diff.filter("previous_path is null and previous_score is not null and current_score is not null"))


@query(f'with {EXACT_KINDS} select g as "group", {KIND_COUNTS} from kinds where kind is not null group by rollup (g)')
def regression_rollup(t: Tables) -> DataFrame:
    return report.regression_rollup(_exact_regressions(t))


@query(f"with {EXACT_KINDS} select path, qualname, kind, round(coalesce(nullif(delta, 0), score), 6) as size from kinds where kind is not null")
def regression_order(t: Tables) -> DataFrame:
    rows = report.regression_order(_exact_regressions(t))
    return rows.select("path", "qualname", "kind", F.round(F.coalesce(F.nullif("delta", F.lit(0.0)), "current_score"), 6).alias("size"))


@query("select lang, count(n_chars)::bigint as n, round(avg(n_chars), 3) as mean, round(median(n_chars), 3) as median from documents group by lang")
def mean_median(t: Tables) -> DataFrame:
    return calibration.mean_median(t("documents"), "n_chars", ["lang"])


SPRAWLS = f"{UNITS}, {CANDIDATE_SQL}, f as (select *, sum(n_lines) over (partition by path)::double as total from u), sp as (select unit, key, fw * (case when n_lines <= 80 then 0::double when n_lines >= 160 then 100::double else (n_lines - 80::double) / 80::double * 100::double end) + tw * (case when total <= a then 0::double when total >= b then 100::double else (total - a) / (b - a) * 100::double end) as v, unit % 4 = 0 as y from f, cands)"


@query(f"""with {SPRAWLS}, r as (select *, rank() over (partition by key order by v) + (count(*) over (partition by key, v) - 1) / 2.0::double as rk from sp),
  s as (select key, {count('y')} as n1, {count('not y')} as n0, sum(case when y then rk::double else 0 end) as r1, round(avg(case when y then v end), 3) as mean_accepted, round(median(case when y then v end), 3) as median_accepted,
  round(avg(case when not y then v end), 3) as mean_rejected, round(median(case when not y then v end), 3) as median_rejected from r group by key)
  select key, n1, n0, round((r1 - n1::double * (n1 + 1) / 2) / (n1::double * n0), 9) as auc, mean_accepted, median_accepted, mean_rejected, median_rejected from s""")
def candidate_separation(t: Tables) -> DataFrame:
    s = model.candidate_sprawl(t.units(), t.spark.createDataFrame(list(CANDIDATES), "key string, fw double, tw double, a double, b double"))
    out = calibration.separation(s.withColumn("y", F.col("unit") % 4 == 0), "sprawl", "y", ["key"])
    return out.select("key", "n1", "n0", F.round("auc", 9).alias("auc"), "mean_accepted", "median_accepted", "mean_rejected", "median_rejected")


def _auc_sql(rank: str) -> str:
    return f"(sum(case when y then {rank}::double else 0 end) - {count('y')}::double * ({count('y')} + 1) / 2) / nullif({count('y')}::double * {count('not y')}, 0)"


@query(f"""with {LABELLED}, z as (select lang, toxic = 1 as y, n_chars as v, doc_id % 50 as m from d),
  r as (select *, rank() over (partition by lang order by v) + (count(*) over (partition by lang, v) - 1) / 2.0::double as rv, rank() over (partition by lang order by m) + (count(*) over (partition by lang, m) - 1) / 2.0::double as rm from z),
  a as (select lang, round({_auc_sql('rv')}, 9) as a, round({_auc_sql('rm')}, 9) as b from r group by lang)
  select count(*)::bigint as groups, round(avg(a - b), 6) as mean_delta, {count('a - b > 0')} as wins, {count('a - b <> 0')} as decided from a where a is not null and b is not null""")
def paired_deltas(t: Tables) -> DataFrame:
    d = _labelled(t).withColumns({"y": F.col("toxic") == 1, "m": F.col("doc_id") % 50})
    a, b = (statistics.mann_whitney(d, v, "y", ["lang"]).withColumn("auc", F.round("auc", 9)) for v in ("n_chars", "m"))
    return calibration.paired(a, b, by="lang").withColumn("mean_delta", F.round("mean_delta", 6))


@query(f"""with {LABELLED}, c as (select lang as corpus, n_chars, doc_id % 50 as m, quality from d union all select 'pooled', n_chars, doc_id % 50, quality from d),
  p as (select corpus, 'n_chars~m' as pair, n_chars::double as x, m::double as y from c union all select corpus, 'quality~n_chars', quality::double, n_chars::double from c),
  r as (select *, rank() over (partition by corpus, pair order by x) + (count(*) over (partition by corpus, pair, x) - 1) / 2.0::double as rx, rank() over (partition by corpus, pair order by y) + (count(*) over (partition by corpus, pair, y) - 1) / 2.0::double as ry from p)
  select corpus, pair, count(*)::bigint as n, round(corr(x, y), 4) as pearson, round(corr(rx::double, ry::double), 4) as spearman from r group by corpus, pair""")
def correlation_matrix(t: Tables) -> DataFrame:
    d = _labelled(t).withColumn("m", F.col("doc_id") % 50)
    return calibration.correlation_matrix(d, [("n_chars", "m"), ("quality", "n_chars")], "lang")


@query("select count(*)::bigint as n_prs, count(quality)::bigint as n_labeled, array_to_string(list_sort(list(distinct source)), ',') as repos from documents left join labels using (doc_id)")
def run_digest(t: Tables) -> DataFrame:
    runs = t("documents").select("doc_id", F.col("source").alias("repo")).join(t("labels"), "doc_id", "left").withColumn("label", F.col("quality").cast("string"))
    return calibration.run_digest(runs).withColumn("repos", F.array_join("repos", ","))


PHRASES = "too (long|complex)|hard to (read|follow)|refactor|simplif|the (and|of)"


@query(f"select conv_id, count(*)::bigint as flags from conversations where regexp_matches(lower(text), '({PHRASES})') group by conv_id")
def review_flag_counts(t: Tables) -> DataFrame:
    return calibration.review_flags(t("conversations"), ["conv_id"], F.lower("text").rlike(PHRASES))


BLEND = "(0.5::double * sprawl + 0.5::double * case when total <= 500 then 0::double when total >= 1000 then 100::double else (total - 500::double) / 500::double * 100::double end)"


@query(f"with {scored_sql()}, x as (select *, sum(n_lines) over (partition by path)::double as total from scored) select unit, severity, round(greatest(0::double, least(100::double, {' + '.join(f'{BLEND if c == "sprawl" else c} * {WEIGHTS[c]!r}::double' for c in COMPONENTS)})), 9) as score from x")
def rescored(t: Tables) -> DataFrame:
    s = t.scored().withColumn("total", F.sum("n_lines").over(Window.partitionBy("path")).cast("double"))
    out = calibration.rescored(s, F.lit(0.5) * F.col("sprawl") + F.lit(0.5) * saturating(F.col("total"), (500.0, 1000.0)))
    return out.select("unit", "severity", F.round("score", 9).alias("score"))


@query(f"with {scored_sql()} select count(*)::bigint as analyzed, count(*)::bigint as emitted, 0::bigint as suppressed, {SEVERITY_COUNTS}, true as coverage_status from scored")
def union_of_backends(t: Tables) -> DataFrame:
    s = t.scored()
    parts = [report.run_summary(s.filter(c), s.filter("false")).withColumn("coverage_status", F.lit(c == "is_public")) for c in ("is_public", "not is_public")]
    return calibration.union_summary(*parts)


@query(f"""with {facts_sql()}, x as (select *, sum(n_lines) over (partition by path)::double as total from facts)
  select unit, cyclomatic::double as f0, round(ln(1 + n_lines::double), 9) as f1, round(ln(1 + total), 9) as f2, round(1 - line_coverage, 9) as f3, round(1 - coalesce(branch_coverage, 1::double), 9) as f4, case when is_public then 1::double else 0::double end as f5, round(ln(1 + commits::double), 9) as f6 from x""")
def feature_vectors(t: Tables) -> DataFrame:
    facts = t.facts().withColumn("file_lines", F.sum("n_lines").over(Window.partitionBy("path"))).withColumn("target", F.col("unit"))
    v = calibration.features(facts)
    return v.select(F.col("target").alias("unit"), *[F.round(F.get("features", F.lit(i)), 9).alias(f"f{i}") for i in range(7)])


INDEX_PATH = "concat(repeat('d/', (p_size % 4)::int), 'k', (p_partkey % 10)::varchar, case when p_partkey % 3 = 0 then '/index.ts' else '/a.ts' end)"


@query(f"with f as (select distinct p_brand as repo, {INDEX_PATH} as path from part), i as (select *, length(path) - length(replace(path, '/', '')) as depth from f where path like '%/index.ts') select repo, path from i where depth = (select min(depth) from i j where j.repo = i.repo)")
def shallowest_index(t: Tables) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    path = F.concat(F.repeat(F.lit("d/"), (size % 4).cast("int")), F.lit("k"), (key % 10).cast("string"), F.when(key % 3 == 0, "/index.ts").otherwise("/a.ts"))
    return graph.shallowest_index(t("part").select(F.col("p_brand").alias("repo"), path.alias("path")).distinct())


TS_FILES = "select p_partkey, concat(p_brand, '/', replace(p_name, ' ', '_'), case p_partkey % 5 when 0 then '.gen.ts' when 1 then '.test.ts' when 2 then '.d.ts' when 3 then '.pb.tsx' else '.ts' end) as path, case when p_partkey % 7 = 0 then concat('import x', chr(10), ' * @generated by a tool') when p_partkey % 7 = 1 then 'say @generated' else '' end as head from part"


@query(f"with f as ({TS_FILES}) select p_partkey, regexp_matches(path, '\\.(pb|gen)\\.[mc]?tsx?$') or head like '%' || chr(10) || ' * @generated%' as generated, not regexp_matches(path, '\\.(test|spec|stories|d|config)\\.[mc]?tsx?$') as product from f")
def typescript_files(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    end = F.when(key % 5 == 0, ".gen.ts").when(key % 5 == 1, ".test.ts").when(key % 5 == 2, ".d.ts").when(key % 5 == 3, ".pb.tsx").otherwise(".ts")
    path = F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), end)
    head = F.when(key % 7 == 0, "import x\n * @generated by a tool").when(key % 7 == 1, "say @generated").otherwise("")
    return t("part").select("p_partkey", names.generated(path, head).alias("generated"), names.product_file(path).alias("product"))


@query(f"with {UNITS}{GROUPED} select path, qualname, coalesce(case when unit % 2 = 0 then 'own' end, grp) as \"group\" from u join grouped using (path)")
def diff_group_fallback(t: Tables) -> DataFrame:
    rows = t.units().select("path", "qualname", F.when(F.col("unit") % 2 == 0, "own").alias("group"))
    return ladder.with_groups(rows, t.groups()).select("path", "qualname", "group")


TRACKED = SNAPSHOTS + """,
tc as (select n.path, n.qualname, o.ordinal as sid, round((case when n.fingerprint = o.fingerprint then 0.55::double else 0::double end) + (case when n.signature = o.signature then 0.20::double else 0::double end)
  + (case when n.path = o.path then 0.10::double else 0::double end) + (case when split_part(n.qualname, '.', -1) = split_part(o.qualname, '.', -1) then 0.05::double else 0::double end)
  + (case when o.coverage_gap = 0 and o.structural_complexity = 0 then 0.05::double else 0::double end) + (case when o.score <= 2 then 0.05::double else 0::double end), 6) as similarity
  from n join o on n.fingerprint = o.fingerprint or n.signature = o.signature or split_part(n.qualname, '.', -1) = split_part(o.qualname, '.', -1)
  where not exists (select 1 from o x where x.path = n.path and x.qualname = n.qualname)),
tb as (select *, max(similarity) over (partition by path, qualname) as best from tc),
tn as (select path, qualname, min(sid) as sid from tb where best >= 0.65::double and best - similarity <= 0.05::double group by path, qualname having count(*) = 1)"""


@query(f"with {TRACKED} select n.path, n.qualname, coalesce(o.ordinal, tn.sid) as sid from n left join o on o.path = n.path and o.qualname = n.qualname left join tn on tn.path = n.path and tn.qualname = n.qualname")
def snapshot_tracking(t: Tables) -> DataFrame:
    rows = t.snapshot(True).select("path", "qualname", "fingerprint", "signature")
    return history.tracked(rows, t.snapshot(False).withColumn("sid", F.col("ordinal"))).select("path", "qualname", "sid")


@query()
def model_comparison(t: Tables) -> DataFrame:
    return calibration.model_comparison(_features(t), ["x1"], ["x1", "x2", "x3"])
