"""Joins and aggregates that attach coverage to functions.

Units have ``unit, path, start_line, end_line``; lines ``path, line, executed``; arcs ``path, pos, src, dst, executed``.
Interval joins are equi-joins on the path and bins of BIN lines, with the interval as residual: a long file with many
functions costs its rows, not rows times functions. Joins whose sides have a row a function or more are merge joins:
Spark's size estimates know neither the rows that bins add nor how well columns are packed, and a table of functions that
is sent to the driver and broadcast for that outgrows its memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardlens.functions.names import shard_prefix, under

#: Lines of a bin, about the median length of a function.
BIN = 64
POLICIES = ("pessimistic", "optimistic", "skip")


def contained(units: DataFrame, points: DataFrame, at: str, bin_size: int | None = BIN) -> DataFrame:
    """Units joined with the points ``at`` whose line lies in their closed span."""
    inside = points[at].between(F.col("start_line"), F.col("end_line"))
    if bin_size is None:
        return units.join(points.hint("merge"), "path").where(inside)
    bins = F.sequence(F.floor(F.col("start_line") / bin_size), F.floor(F.col("end_line") / bin_size))
    u = units.withColumn("_bin", F.explode(bins))
    p = points.withColumn("_bin", F.floor(F.col(at) / bin_size))
    return u.join(p.hint("merge"), ["path", "_bin"]).where(p[at].between(F.col("start_line"), F.col("end_line"))).drop("_bin")


def line_coverage(units: DataFrame, lines: DataFrame) -> DataFrame:
    """``unit, n_lines_measured, n_executed, line_coverage, missing_lines``; null counts where no line was measured.

    A line that is both executed and missing counts once, as executed.
    """
    each = contained(units, lines, "line").groupBy("unit", "line").agg(F.bool_or("executed").alias("executed"))
    return each.groupBy("unit").agg(
        F.count("*").alias("n_measured"), F.count_if(F.col("executed")).alias("n_executed"),
        (F.count_if(F.col("executed")) / F.count("*")).alias("line_coverage"),
        F.sort_array(F.collect_list(F.when(~F.col("executed"), F.col("line")))).alias("missing_lines"),
    )


def branch_coverage(units: DataFrame, arcs: DataFrame) -> DataFrame:
    """``unit, n_arcs, n_taken, branch_coverage, missing_branches``: arcs by their source line, duplicates kept."""
    one = F.when(~F.col("executed"), F.struct("pos", "src", "dst"))
    out = contained(units, arcs, "src").groupBy("unit").agg(
        F.count("*").alias("n_arcs"), F.count_if(F.col("executed")).alias("n_taken"),
        (F.count_if(F.col("executed")) / F.count("*")).alias("branch_coverage"), F.sort_array(F.collect_list(one)).alias("m"),
    )
    pairs = F.transform("m", lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst")))
    return out.withColumn("missing_branches", pairs).drop("m")


def with_coverage(units: DataFrame, lines: DataFrame, arcs: DataFrame, files: DataFrame, policy: str = "pessimistic") -> DataFrame:
    """``units`` plus ``line_coverage`` and ``branch_coverage`` (null: not measured).

    ``files`` (``path``) are those with a coverage record. A recorded file without measured lines in a span counts as
    covered; a file without a record follows the policy: 0 %, 100 %, or its units go.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    lc = line_coverage(units, lines).select("unit", "line_coverage")
    bc = branch_coverage(units, arcs).select("unit", "branch_coverage")
    out = units.join(files.select("path").distinct().withColumn("_seen", F.lit(True)), "path", "left")
    out = out.join(lc.hint("merge"), "unit", "left").join(bc.hint("merge"), "unit", "left")
    absent = F.col("_seen").isNull()
    if policy == "skip":
        out = out.filter(~absent)
    share = F.when(absent, F.lit(1.0 if policy == "optimistic" else 0.0)).otherwise(F.coalesce("line_coverage", F.lit(1.0)))
    return out.withColumn("line_coverage", share).withColumn("branch_coverage", F.when(~absent, F.col("branch_coverage"))).drop("_seen")


def suffix_lookup(wanted: DataFrame, records: DataFrame, prefer: str = "first") -> DataFrame:
    """``path, record``: for each wanted path the coverage record of that path, else of one that ends with it.

    ``records`` has ``record`` (its path) and ``ordinal``. Of several, the first in order or the longest path.
    """
    tie = {"first": F.struct("ordinal"), "longest": F.struct((-F.length("record")).alias("n"), F.col("ordinal"))}[prefer]
    w = wanted.select("path").distinct()
    parts = F.split("record", "/")
    # every suffix of a record that begins after a slash, and the record itself: an equi-join on whole paths
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    joined = w.join(records.withColumn("path", F.explode(F.array_distinct(ends))), "path")
    order = F.struct((F.col("record") != F.col("path")).alias("other"), tie.alias("tie"))
    best = joined.groupBy("path").agg(F.min_by("record", order).alias("record"))
    return w.join(best, "path", "left")


def shard_lookup(wanted: DataFrame, shards: DataFrame, records: DataFrame) -> DataFrame:
    """``path, prefix, record``: the longest shard prefix above a path *whose shard has a record for it*.

    ``shards``: ``prefix``; ``records``: ``prefix, record``. The rank is taken after the hit, so a longer prefix without
    a record falls through. Prefixes are few (configuration), so they are joined by a broadcast theta join if small.
    """
    s = shards.select("prefix", shard_prefix(F.col("prefix")).alias("clean")).distinct()
    w = wanted.select("path").distinct()
    pairs = w.join(s, under(F.col("path"), F.col("clean")))
    hits = pairs.join(records, "prefix").filter((F.col("record") == F.col("path")) | F.endswith(F.col("record"), F.concat(F.lit("/"), F.col("path"))))
    order = F.struct((-F.length("prefix")).alias("n"), F.col("prefix"), F.col("record"))
    best = hits.groupBy("path").agg(F.min(order).alias("b")).select("path", "b.prefix", "b.record")
    return w.join(best, "path", "left")


def longest_prefix(wanted: DataFrame, groups: DataFrame, name: str = "group") -> DataFrame:
    """``path, group``: longest prefix; of equal ones the largest group name; null where none fits."""
    w = wanted.select("path").distinct()
    pairs = w.join(groups.select(F.col("name"), F.col("prefix")), under(F.col("path"), F.col("prefix")), "left")
    return pairs.groupBy("path").agg(F.max_by("name", F.struct(F.length("prefix"), F.col("name"))).alias(name))


def statement_lines(units: DataFrame, statements: DataFrame) -> DataFrame:
    """``unit, n_lines, n_hit, line_coverage`` of statements (``path, line, hits``), a line's hits being the most of any."""
    each = contained(units, statements, "line").groupBy("unit", "line").agg(F.max("hits").alias("hits"))
    n, hit = F.count("*"), F.count_if(F.col("hits") > 0)
    return each.groupBy("unit").agg(n.alias("n_lines"), hit.alias("n_hit"), (hit / n).alias("line_coverage"))


def branch_arms(units: DataFrame, branches: DataFrame) -> DataFrame:
    """``unit, n_arms, n_taken, missing_arms``: each arm of ``branches`` (``path, ordinal, line, arms array``) counts."""
    arms = branches.select("path", "ordinal", "line", F.posexplode("arms").alias("arm", "hits"))
    joined = contained(units.select("unit", "path", "start_line", "end_line"), arms, "line")
    missing = F.when(F.col("hits") == 0, F.struct("ordinal", "line", "arm"))
    out = joined.groupBy("unit").agg(F.count("*").alias("n_arms"), F.count_if(F.col("hits") > 0).alias("n_taken"), F.sort_array(F.collect_list(missing)).alias("m"))
    return out.withColumn("missing_arms", F.transform("m", lambda x: F.struct(x["line"].alias("line"), x["arm"].alias("arm")))).drop("m")


def aligned(units: DataFrame, points: DataFrame, at: str = "line") -> DataFrame:
    """``path, aligned``: whether any point of a file falls in any of its units; true for files without points."""
    hit = contained(units, points, at).select("path").distinct().withColumn("hit", F.lit(True))
    has = points.select("path").distinct().withColumn("has", F.lit(True))
    out = units.select("path").distinct().join(has, "path", "left").join(hit, "path", "left")
    return out.select("path", (F.col("has").isNull() | F.coalesce("hit", F.lit(False))).alias("aligned"))


def first_enclosing(units: DataFrame, points: DataFrame, at: str = "line") -> DataFrame:
    """Points plus ``unit``: the first unit in discovery order (``ordinal``) that contains the line, so the outermost.

    Places are looked up by their path and line: row numbers would differ where Spark computes the points twice. Of units
    with one ordinal the smallest counts.
    """
    hits = contained(units.select("path", "unit", "ordinal", "start_line", "end_line"), points.select("path", at).distinct(), at)
    best = hits.groupBy("path", at).agg(F.min_by("unit", F.struct("ordinal", "unit")).alias("unit"))
    return points.join(best.hint("merge"), ["path", at], "left")


def joined_ints(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def latest(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The last row of each key by ``ordinal``."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(ordinal)).alias("r")).select(*keys, "r.*")


def ordered(rows: DataFrame, by: str, name: str = "ordinal") -> DataFrame:
    """``rows`` numbered from 1 in the order of ``by`` (small dimension tables: one ordered window)."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(by)))
