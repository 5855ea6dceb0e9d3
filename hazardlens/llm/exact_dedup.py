"""Exact dedup by content sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardlens.llm.io import Stash

#: Hot texts are those with more copies than this and more than one row in HOT_PART; so at most HOT_PART are hot.
HOT_COPIES, HOT_PART = 500, 10_000
#: Characters of a text that its range key begins with; 8 bytes of its digest follow.
LEAD = 48


def content_groups(docs: DataFrame, stash: Stash, partitions: int | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Equal texts (null counts as empty; no other normalisation) form a group; its row with the largest ``doc_id``
    stays, and one of them only where whole rows repeat. Null ids sort below all others. Empty input: empty result.

    ``repartitionByRange`` samples splitters over short keys, a leading part and some bytes of a digest, so that neither the
    driver gets long texts nor texts that begin alike stay together, and deals whole texts out by range; an
    external sort within each partition puts equals side by side, and windows over that order compare whole neighbouring texts.
    The one exchange of the texts also serves the windows. Copies of a very common text would fall to one task, so they
    are grouped by the whole text before any exchange (partial aggregation) and joined with their group by the whole text.
    Which texts are hot comes from counts by digest, pre-aggregated in each task. At most 10,000 can have more than one in
    10,000 of the rows, and these texts are in all no longer than 10,000 mean texts, which bounds the broadcasts.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    counts = stash.keep(rows.groupBy("digest").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_COPIES), "hot")
    total = docs.select("doc_id").agg(F.count("*").alias("total"))
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("n") * HOT_PART > F.col("total")).select("digest", F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.substring("text", 1, LEAD).alias("lead"), F.substring("digest", 1, 8).alias("part")]
    cool = rows.filter(F.col("hot").isNull()).select("doc_id", "text", "digest", *key)
    cool = cool.repartitionByRange(n, "lead", "part").sortWithinPartitions("lead", "part", "text", F.desc("doc_id"))
    first = Window.partitionBy("lead", "part", "text").orderBy(F.desc("doc_id"))
    cool = cool.select(
        "doc_id", "digest", F.first("doc_id").over(first).alias("keep_id"), F.row_number().over(first).alias("place"),
        F.count("*").over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("group_size"),
    )
    warm = rows.filter("hot").select("doc_id", "text", "digest")
    heads = stash.keep(warm.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "heads")
    warm = warm.join(F.broadcast(heads), "text").select("doc_id", "digest", "keep_id", "group_size")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    place = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id"))  # of the few rows with a group's largest id
    out = cool.unionByName(warm.filter(best).withColumn("place", place)).unionByName(warm.filter(~best).withColumn("place", F.lit(0)))
    return out.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
  count(*) over (partition by coalesce(text, ''))::bigint as group_size,
  row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
  sha256(coalesce(text, '')) as text_sha256 from documents
"""
