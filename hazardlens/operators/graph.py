"""Reachability over edge tables, and which exported names of a module graph are public."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reachable(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """``node``: all that the edges (``a`` to ``b``) reach from ``roots`` in at most ``depth`` steps.

    A frontier is joined with the edges and cut down to new nodes; cycles end by themselves. Lineage is cut each round
    where the session has a checkpoint folder.
    """
    seen = roots.select("node").distinct()
    frontier, step = seen, 0
    while depth is None or step < depth:
        new = frontier.join(edges, frontier["node"] == edges["a"]).select(F.col("b").alias("node")).distinct()
        new = _cut(new.join(seen, "node", "left_anti"))
        if not new.limit(1).count():
            break
        seen, frontier, step = _cut(seen.unionByName(new)), new, step + 1
    return seen


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return df.checkpoint() if folder else df.cache()


EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".d.ts")


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (``file, specifier``) plus ``to``: the file that a relative specifier means, null if none.

    Tried in order: the path itself, it with each extension, ``index`` in it; a JavaScript extension is dropped first.
    """
    dots = F.concat(F.regexp_replace("file", "[^/]*$", ""), F.col("specifier"))
    parts = F.filter(F.split(dots, "/"), lambda s: ~s.isin("", "."))
    empty = F.array().cast("array<string>")
    step = lambda acc, s: F.when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    path = F.array_join(F.aggregate(parts, empty, step), "/")
    bare = F.regexp_replace(path, "\\.(m|c)?jsx?$", "")
    tries = [path, *[F.concat(bare, F.lit(e)) for e in EXTENSIONS], *[F.concat(bare, F.lit("/index" + e)) for e in EXTENSIONS[:2]]]
    rows = imports.filter(F.startswith("specifier", F.lit("."))).select("file", "specifier", F.posexplode(F.array(*tries)).alias("rank", "to"))
    hits = rows.join(files.select(F.col("file").alias("to")).distinct(), "to")
    best = hits.groupBy("file", "specifier").agg(F.min_by("to", "rank").alias("to"))
    return imports.join(best, ["file", "specifier"], "left")


def public_names(exports: DataFrame, entries: DataFrame, files: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Names that entry files export, through forwards and stars.

    ``exports``: ``file, export_name, kind (local, forward, star), local_name, specifier, source_name``. Gives local
    names reached (``file, name``), names that an unresolved forward leaves uncertain (``name``), and whether an
    unresolved star or a missing entry leaves everything uncertain. ``export *`` never carries ``default``.
    """
    to = resolved(exports.filter("specifier is not null").select("file", "specifier").distinct(), files)
    e = exports.join(to, ["file", "specifier"], "left").cache()
    want = entries.join(exports.select("file", "export_name", "kind"), "file").filter("kind <> 'star'").select("file", F.col("export_name").alias("name"))
    star = entries.select("file")
    stars = reachable(e.filter("kind = 'star' and to is not null").select(F.col("file").alias("a"), F.col("to").alias("b")), star.withColumnRenamed("file", "node"), depth)
    more = stars.withColumnRenamed("node", "file").join(exports, "file").filter("kind <> 'star' and export_name <> 'default'").select("file", F.col("export_name").alias("name"))
    node = lambda f, n: F.concat_ws("\0", f, n)
    hop = e.filter("kind = 'forward' and to is not null").select(node(F.col("file"), F.col("export_name")).alias("a"), node(F.col("to"), F.col("source_name")).alias("b"))
    roots = want.unionByName(more).select(node(F.col("file"), F.col("name")).alias("node"))
    got = reachable(hop, roots, depth).select(F.split_part("node", F.lit("\0"), F.lit(1)).alias("file"), F.split_part("node", F.lit("\0"), F.lit(2)).alias("export_name"))
    locals_ = got.join(e.filter("kind = 'local'"), ["file", "export_name"]).select("file", F.col("local_name").alias("name")).distinct()
    lost = got.join(e.filter("kind = 'forward' and to is null"), ["file", "export_name"]).select(F.col("source_name").alias("name")).distinct()
    bad_star = stars.withColumnRenamed("node", "file").join(e.filter("kind = 'star' and to is null"), "file").limit(1).count()
    absent = entries.join(files, "file", "left_anti").limit(1).count()
    return locals_, lost, bool(bad_star or absent)


def narrowed(functions: DataFrame, reached: DataFrame, uncertain: DataFrame, poisoned: bool) -> DataFrame:
    """``functions`` (``file, qualname, is_public``): public ones that are neither reached nor uncertain become private."""
    if poisoned:
        return functions
    f = functions.withColumn("name", F.split_part("qualname", F.lit("."), F.lit(1)))
    f = f.join(reached.withColumn("_r", F.lit(True)), ["file", "name"], "left").join(uncertain.withColumn("_u", F.lit(True)), "name", "left")
    return f.withColumn("is_public", F.col("is_public") & (F.col("_r").isNotNull() | F.col("_u").isNotNull())).select(*functions.columns)


def shallowest_index(files: DataFrame) -> DataFrame:
    """The ``index`` files (``repo, path``) at the least depth of each repo: its entries where none are configured."""
    own = files.filter(F.col("path").rlike("(^|/)index\\.[mc]?[jt]sx?$")).withColumn("depth", F.size(F.split("path", "/")))
    least = own.groupBy("repo").agg(F.min("depth").alias("depth"))
    return own.join(least, ["repo", "depth"]).select("repo", "path")
