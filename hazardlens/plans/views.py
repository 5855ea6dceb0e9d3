"""Facts about functions derived from the driver's tables, and the same in SQL for the oracles.

The tables hold no source code; these views give every operator realistic inputs: spans, coverage, arcs, hunks,
snapshots before and after. All are deterministic functions of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardlens.operators import churn, coverage, report

CUTOFF_DAYS = 90
GROUPS = (("b1", "Brand#1"), ("b12", "Brand#12"), ("same", "Brand#12"), ("promo", "Brand#13/promo.py"), ("any", "."))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def units(self) -> DataFrame:
        p = self("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        n = F.col("p_size") * 4
        before = F.sum(n).over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1))
        p = p.withColumn("start_line", (F.lit(1) + F.coalesce(before, F.lit(0))).cast("int"))
        return p.select(
            F.col("p_partkey").alias("unit"), F.col("p_partkey").alias("ordinal"), F.concat("p_brand", F.lit("/"), F.lower("p_type"), F.lit(".py")).alias("path"),
            F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".f"), F.col("p_partkey").cast("string")).alias("qualname"),
            "start_line", (F.col("start_line") + n - 1).cast("int").alias("end_line"), n.cast("int").alias("n_lines"),
            (F.col("p_partkey") % 3 != 0).alias("is_public"), (F.lit(1) + F.col("p_size") % 25).cast("int").alias("cyclomatic"),
        )

    def touched(self) -> DataFrame:
        """One row per line item: where in its part's file it falls."""
        li = self("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
        u = self.units().select("unit", "path", "start_line", "n_lines")
        out = li.join(u.hint("merge"), F.col("l_partkey") == F.col("unit"))  # as in coverage: parts are as many as functions
        return out.withColumn("line", (F.col("start_line") + F.col("l_orderkey") % F.col("n_lines")).cast("int")).drop("unit", "start_line", "n_lines")

    def lines(self) -> DataFrame:
        hit = (F.col("l_returnflag") != "R") & (F.col("l_linestatus") == "F")
        return self.touched().filter(~F.startswith("path", F.lit("Brand#1/"))).groupBy("path", "line").agg(F.bool_or(hit).alias("executed"))

    def arcs(self) -> DataFrame:
        t = self.touched()
        pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        return t.select("path", pos.alias("pos"), F.col("line").alias("src"), (F.col("line") + F.col("l_linenumber")).alias("dst"), (F.col("l_linestatus") == "F").alias("executed"))

    def hunks(self, all_time: bool = False) -> DataFrame:
        o = self("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("ts"))
        h = self.touched().join(o.hint("merge"), "l_orderkey").select(
            F.col("l_orderkey").alias("commit"), "ts", "path", F.col("line").alias("start"), (F.col("line") + F.col("l_quantity").cast("int") - 1).alias("end"))
        if all_time:
            return h
        newest = o.agg(F.max("ts")).first()[0]
        return churn.since(h, newest - days(CUTOFF_DAYS))

    def facts(self, policy: str = "pessimistic") -> DataFrame:
        u = self.units()
        lines = self.lines()
        out = coverage.with_coverage(u, lines, self.arcs(), lines.select("path"), policy)
        return out.join(churn.function_churn(u, self.hunks()).hint("merge"), "unit")

    def scored(self, policy: str = "pessimistic", weights=None) -> DataFrame:
        return report.scored(self.facts(policy), weights)

    def groups(self) -> DataFrame:
        return self.spark.createDataFrame(list(GROUPS), "name string, prefix string")

    def snapshot(self, new: bool) -> DataFrame:
        d = self("documents").filter(F.col("doc_id") % 3 != (1 if new else 0))
        before = (F.col("n_chars") % 97).cast("double")
        after = F.greatest(F.lit(0.0), F.least(F.lit(100.0), before + (F.col("doc_id") % 21 - 10).cast("double") * F.lit(0.7)))
        path = F.when((F.col("doc_id") % 7 == 0) & F.lit(new), F.concat(F.lit("moved/"), F.col("source"))).otherwise(F.col("source"))
        more = F.when((F.col("doc_id") % 5 == 0) & F.lit(new), 20).otherwise(0)
        zero = [F.lit(0.0).alias(c) for c in ("branch_gap", "churn", "public_surface", "sprawl")]
        return d.select(
            path.alias("path"), F.concat(F.col("lang"), F.lit(".d"), F.col("doc_id").cast("string")).alias("qualname"), F.col("doc_id").alias("ordinal"),
            (after if new else before).alias("score"), before.alias("coverage_gap"), (F.col("n_chars") % 89 + more).cast("double").alias("structural_complexity"), *zero,
            F.sha2("text", 256).alias("fingerprint"), F.sha2(F.substring("text", 1, 24), 256).alias("signature"), F.col("lang").alias("group"), F.lit("python").alias("language"),
        )


def days(n: int):
    from datetime import timedelta

    return timedelta(days=n)


UNITS = """
units as (select p_partkey as unit, p_partkey as ordinal, concat(p_brand, '/', lower(p_type), '.py') as path,
  concat(replace(p_name, ' ', '_'), '.f', p_partkey::varchar) as qualname,
  (1 + coalesce(sum(p_size * 4) over (partition by p_brand, p_type order by p_partkey rows between unbounded preceding and 1 preceding), 0))::int as start_line,
  (p_size * 4)::int as n_lines, p_partkey % 3 <> 0 as is_public, (1 + p_size % 25)::int as cyclomatic from part),
u as (select *, start_line + n_lines - 1 as end_line from units),
touched as (select l.*, u.path, (u.start_line + l_orderkey % u.n_lines)::int as line from lineitem l join u on l_partkey = u.unit)"""

LINES = UNITS + """,
lines as (select path, line, bool_or(l_returnflag <> 'R' and l_linestatus = 'F') as executed from touched where not starts_with(path, 'Brand#1/') group by path, line),
arcs as (select path, l_orderkey * 10 + l_linenumber as pos, line as src, line + l_linenumber as dst, l_linestatus = 'F' as executed from touched),
everhunks as (select l_orderkey as commit, o_orderdate as ts, path, line as start_, line + l_quantity::int - 1 as end_ from touched join orders on o_orderkey = l_orderkey),
hunks as (select * from everhunks where ts >= (select max(o_orderdate) from orders) - interval '90' day)"""

LC = LINES + """,
lc as (select unit, count(*)::bigint as n_measured, count(case when executed then 1 end)::bigint as n_executed,
  count(case when executed then 1 end)::double / count(*) as line_coverage from u join lines on u.path = lines.path and line between start_line and end_line group by unit),
bc as (select unit, count(*)::bigint as n_arcs, count(case when executed then 1 end)::bigint as n_taken,
  count(case when executed then 1 end)::double / count(*) as branch_coverage from u join arcs on u.path = arcs.path and src between start_line and end_line group by unit),
ch as (select u.unit, count(distinct h.commit)::bigint as commits from u left join hunks h on u.path = h.path and start_ <= end_line and start_line <= end_ group by u.unit)"""


def facts_sql(policy: str = "pessimistic") -> str:
    absent = {"pessimistic": "0::double", "optimistic": "1::double", "skip": "null"}[policy]
    keep = "where seen.path is not null" if policy == "skip" else ""
    return LC + f""",
facts as (select u.*, case when seen.path is null then {absent} else coalesce(line_coverage, 1::double) end as line_coverage,
  case when seen.path is not null then branch_coverage end as branch_coverage, commits
  from u left join (select distinct path from lines) seen on seen.path = u.path left join lc using (unit) left join bc using (unit) join ch using (unit) {keep})"""


def scored_sql(policy: str = "pessimistic", weights: dict[str, float] | None = None) -> str:
    from hazardlens.functions.scoring import COMPONENTS, WEIGHTS

    w = weights or WEIGHTS
    total = " + ".join(f"{c} * {w[c]!r}::double" for c in COMPONENTS)
    sat = lambda v, a, b: f"case when {v} <= {a} then 0::double when {v} >= {b} then 100::double else ({v} - {a}::double) / ({b}::double - {a}::double) * 100::double end"
    return facts_sql(policy) + f""",
parts as (select *, greatest(0::double, least(1::double, 1::double - line_coverage)) * 100::double as coverage_gap, {sat('cyclomatic', 1, 21)} as structural_complexity,
  case when branch_coverage is null then 0::double else greatest(0::double, least(1::double, 1::double - branch_coverage)) * 100::double end as branch_gap,
  {sat('commits', 0, 10)} as churn, case when is_public then greatest(0::double, least(1::double, 1::double - line_coverage)) * 100::double else 0::double end as public_surface,
  {sat('n_lines', 80, 160)} as sprawl from facts),
scored0 as (select *, greatest(0::double, least(100::double, {total})) as score,
  cyclomatic::double * cyclomatic::double * ((1::double - line_coverage) * (1::double - line_coverage) * (1::double - line_coverage)) + cyclomatic::double as crap from parts),
scored as (select *, case when score >= 75 then 'critical' when score >= 50 then 'high' when score >= 25 then 'medium' else 'low' end as severity from scored0)"""


def _snap(name: str, new: bool) -> str:
    before = "(n_chars % 97)::double"
    score = f"greatest(0::double, least(100::double, {before} + (doc_id % 21 - 10)::double * 0.7::double))" if new else before
    path = "case when doc_id % 7 = 0 then concat('moved/', source) else source end" if new else "source"
    more = "case when doc_id % 5 = 0 then 20 else 0 end" if new else "0"
    return f"""{name} as (select {path} as path, concat(lang, '.d', doc_id::varchar) as qualname, doc_id as ordinal, {score} as score, {before} as coverage_gap,
  (n_chars % 89 + {more})::double as structural_complexity, sha256(text) as fingerprint, sha256(substr(text, 1, 24)) as signature, lang as grp
  from documents where doc_id % 3 <> {1 if new else 0})"""


SNAPSHOTS = _snap("o", False) + ",\n" + _snap("n", True) + """,
ex as (select n.* from n join o using (path, qualname)),
fp as (select n.path, n.qualname, n.ordinal, o.path as old_path, o.qualname as old_qualname
  from (select *, count(*) over (partition by fingerprint) as c from n) n join (select *, count(*) over (partition by fingerprint) as c from o) o using (fingerprint)
  where n.c = 1 and o.c = 1 and not exists (select 1 from o x where x.path = n.path and x.qualname = n.qualname) and not exists (select 1 from n y where y.path = o.path and y.qualname = o.qualname)),
ln as (select * from n where not exists (select 1 from o where o.path = n.path and o.qualname = n.qualname) and not exists (select 1 from fp where fp.path = n.path and fp.qualname = n.qualname)),
lo as (select * from o where not exists (select 1 from n where o.path = n.path and o.qualname = n.qualname) and not exists (select 1 from fp where fp.old_path = o.path and fp.old_qualname = o.qualname)),
p0 as (select ln.path, ln.qualname, ln.ordinal, lo.path as old_path, lo.qualname as old_qualname,
  case when (ln.coverage_gap = 0 and ln.structural_complexity = 0) and (lo.coverage_gap = 0 and lo.structural_complexity = 0) then 1::double
       when (ln.coverage_gap = 0 and ln.structural_complexity = 0) or (lo.coverage_gap = 0 and lo.structural_complexity = 0) then 0::double
       else (ln.coverage_gap * lo.coverage_gap + ln.structural_complexity * lo.structural_complexity) /
         (sqrt(ln.coverage_gap * ln.coverage_gap + ln.structural_complexity * ln.structural_complexity) * sqrt(lo.coverage_gap * lo.coverage_gap + lo.structural_complexity * lo.structural_complexity)) end as shape,
  ln.signature = lo.signature as same_sig, ln.path = lo.path as same_path, split_part(ln.qualname, '.', -1) = split_part(lo.qualname, '.', -1) as same_tail, abs(ln.score - lo.score) <= 2::double as near_score
  from ln join lo using (fingerprint)),
p1 as (select path, qualname, ordinal, old_path, old_qualname, round(0.55::double + (case when same_sig then 0.20::double else 0::double end) + (case when same_path then 0.10::double else 0::double end)
  + (case when same_tail then 0.05::double else 0::double end) + (case when shape >= 0.95::double then 0.05::double else 0::double end) + (case when near_score then 0.05::double else 0::double end), 6) as similarity from p0),
cand as (select *, max(similarity) over (partition by path, qualname, ordinal) as best from p1)"""
