"""LCOV reports as tables: one row per report line, records found by order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def records(texts: DataFrame) -> DataFrame:
    """Lines of reports (``report, text``) with ``record`` (place of its SF line) and ``path``; later records of a path win.

    A byte order mark is dropped; a missing end_of_record ends with the next SF or the file; a record whose DA lines
    are all malformed is dropped.
    """
    text = F.regexp_replace("text", "^\\x{FEFF}", "")
    rows = texts.select("report", F.posexplode(F.split(text, "\\r?\\n")).alias("pos", "line")).withColumn("line", F.btrim("line"))
    so_far = Window.partitionBy("report").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.startswith("line", F.lit("SF:")), F.struct(F.col("pos").alias("pos"), F.substring("line", 4, 1 << 30).alias("path")))
    mark = mark.when(F.col("line") == "end_of_record", F.struct(F.lit(-1).alias("pos"), F.lit("").alias("path")))
    rows = rows.withColumn("m", F.last(mark, ignorenulls=True).over(so_far)).filter("m.pos >= 0").select("report", "pos", "line", F.col("m.pos").alias("record"), F.replace("m.path", F.lit("\\"), F.lit("/")).alias("path"))
    da = F.startswith("line", F.lit("DA:"))
    own = Window.partitionBy("report", "record")
    rows = rows.withColumn("das", F.count_if(da).over(own)).withColumn("good", F.count_if(da & F.col("line").rlike("^DA:\\s*\\d+\\s*,\\s*\\d+")).over(own))
    rows = rows.filter((F.col("das") == 0) | (F.col("good") > 0)).drop("das", "good")
    last = F.max("record").over(Window.partitionBy("report", "path"))
    return rows.withColumn("last", last).filter("record = last").drop("last")


def statements(rows: DataFrame) -> DataFrame:
    """``path, line, hits`` of well-formed DA lines."""
    m = lambda i: F.regexp_extract("line", "^DA:\\s*(\\d+)\\s*,\\s*(\\d+)", i)
    return rows.filter(F.col("line").rlike("^DA:\\s*\\d+\\s*,\\s*\\d+")).select("path", m(1).cast("long").alias("line_no"), m(2).cast("long").alias("hits")).withColumnRenamed("line_no", "line")


def branches(rows: DataFrame) -> DataFrame:
    """``path, ordinal, line, arms``: BRDA lines of one line and block, in order; ``-`` is 0."""
    p = "^BRDA:\\s*(\\d+)\\s*,\\s*([^,]+),\\s*([^,]+),\\s*(-|\\d+)\\s*$"
    m = lambda i: F.regexp_extract("line", p, i)
    each = rows.filter(F.col("line").rlike(p)).select("path", "pos", m(1).cast("int").alias("line_no"), m(2).alias("block"), F.when(m(4) == "-", 0).otherwise(m(4).try_cast("int")).alias("hits"))
    out = each.groupBy("path", "line_no", "block").agg(F.min("pos").alias("ordinal"), F.sort_array(F.collect_list(F.struct("pos", "hits"))).alias("a"))
    return out.select("path", "ordinal", F.col("line_no").alias("line"), F.transform("a", lambda x: x["hits"]).alias("arms"))


def functions(rows: DataFrame) -> DataFrame:
    """``path, line, name, hits`` of FN lines with the hits of their FNDA lines."""
    fn = rows.filter(F.col("line").rlike("^FN:\\d+,")).select("path", F.regexp_extract("line", "^FN:(\\d+),", 1).cast("int").alias("at"), F.regexp_extract("line", "^FN:\\d+,(?:\\d+,)?(.+)$", 1).alias("name"))
    hits = rows.filter(F.col("line").rlike("^FNDA:\\d+,")).groupBy("path", F.regexp_extract("line", "^FNDA:\\d+,(.+)$", 1).alias("name")).agg(F.max(F.regexp_extract("line", "^FNDA:(\\d+),", 1).cast("long")).alias("hits"))
    return fn.join(hits, ["path", "name"], "left").select("path", F.col("at").alias("line"), "name", F.coalesce("hits", F.lit(0)).alias("hits"))


def looks_like(text, path):
    """Whether a report is LCOV: by its suffix, else by how its first non-blank line begins."""
    return F.lower(path).rlike("\\.(info|lcov)$") | (~F.lower(path).rlike("\\.json$") & F.regexp_extract(text, "^\\s*(\\S+)", 1).rlike("^(SF|TN|VER):"))
