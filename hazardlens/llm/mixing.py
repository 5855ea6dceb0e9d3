"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardlens.llm.exprs import n_words, spare
from hazardlens.llm.io import Stash

WEIGHTS = (5, 2, 1)


def water_filled(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """One row per source: ``rank, source, source_size, target``.

    ``sizes`` has one row per source (``source, source_size``). The budget is ``budget`` times all sizes. Sources in
    code point order (null last) weigh ``weights``, repeating. A source is clamped at ``max_epochs`` times its size and
    what it cannot take is shared again by weight. The set of clamped sources is a prefix of the order by cap per
    weight, so two running sums give the fixed point of that resharing without iterating.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "rank")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.lit(float(budget)) * F.sum("source_size").over(every).cast("double")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("share") - F.col("before").cast("double")) / F.col("left").cast("double")
    ranked = ranked.select("*", share.alias("share"), before.alias("before"), left.alias("left"))
    ranked = ranked.withColumn("clamped", F.col("cap").cast("double") <= level * F.col("weight").cast("double"))
    spent = F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(F.lit(0))).over(every).cast("double")
    open_weight = F.sum(F.when(F.col("clamped"), F.lit(0)).otherwise(F.col("weight"))).over(every).cast("double")
    ranked = ranked.select("*", spent.alias("spent"), open_weight.alias("open_weight"))
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(
        (F.col("share") - F.col("spent")) / F.nullif(F.col("open_weight"), F.lit(0.0)) * F.col("weight").cast("double")
    )
    return ranked.select("rank", "source", "source_size", target.alias("target"))


def _seeded(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, stash: Stash, weights=WEIGHTS, budget: float = 1.5, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, taken``.

    ``size`` is the number of words (null or blank text: 0). Every document is taken ``floor(target / source_size)``
    whole times; the rest of the target goes over the source's documents in an order given by a seeded hash, one more
    repetition each until it is used up, the document at the boundary with a fraction of its words. So the words taken
    add up to the floor of the target, reruns agree, and no document passes ``max_epochs`` times its size. A source
    without words has target 0. Repeated rows are separate documents. Empty input: empty result. Other columns are
    not read. The running sums go by hash prefix (4,096 blocks a source) before rows are ordered within a block, so
    that a hot source is not gathered in one task.
    """
    rows = stash.keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    sources = stash.keep(
        water_filled(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_epochs), "sources"
    )
    rows = rows.withColumn("key", _seeded(F.col("doc_id"), seed)).withColumn("block", F.substring("key", 1, 3))
    s = sources.withColumnRenamed("source", "of_source")
    rows = rows.join(s, rows["source"].eqNullSafe(s["of_source"])).drop("of_source")
    blocks = rows.groupBy("rank", "block").agg(F.sum("size").alias("block_size"))
    start = F.sum("block_size").over(Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("rank", "block", F.coalesce(start, F.lit(0)).alias("block_start"))
    within = Window.partitionBy("rank", "block").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(blocks, ["rank", "block"])
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    extra = F.floor("target") - whole * F.col("source_size") - F.col("block_start") - F.col("before")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), extra))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, stash: Stash, **how) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix`` takes it.

    A fraction of a document's words counts as a whole repetition from one half on. Documents without words have no
    weight in the mix and stay once. Rows are told apart by a hash of all their columns; those that are equal in all are
    shared what is taken of them, and the rounding up goes to the first. Rows of one id whose text or other columns differ are
    separate documents.
    """
    name, key, times, copy, rows = spare(docs, "name", "key", "times", "copy", "rows")
    keyed = docs.withColumns({name: F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), key: F.xxhash64(*docs.columns)})
    own = keyed.select(F.struct(F.col(name).alias("name"), F.col(key).alias("key")).alias("doc_id"), "source", "text")
    taken = mix(own, stash, **how).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count("*").alias("rows"))
    whole = F.when(F.col("size") == 0, F.col("rows")).otherwise(F.floor(F.col("taken") / F.nullif(F.col("size"), F.lit(0)) + 0.5))
    taken = taken.select(F.col("doc_id.name").alias(name), F.col("doc_id.key").alias(key), whole.cast("int").alias(times), F.col("rows").alias(rows))
    taken = stash.keep(taken.filter(F.col(times) > 0), "taken")
    out = keyed.join(taken.hint("shuffle_hash"), [name, key])
    if taken.filter(F.col(rows) > 1).limit(1).count():  # whole rows repeat
        out = out.dropDuplicates([name, key])
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)


ORACLE = r"""
with rows as (
  select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size
  from documents),
sizes as (select source, sum(size)::bigint as source_size from rows group by source),
r1 as (select *, row_number() over (order by source nulls last) as rank from sizes),
r2 as (select *, ([5, 2, 1])[((rank - 1) % 3 + 1)::int]::bigint as weight, source_size * 2 as cap from r1),
r3 as (select *, 1.5::double * (sum(source_size) over ())::double as share,
  coalesce(sum(cap) over (order by cap::double / weight, rank rows between unbounded preceding and 1 preceding), 0)::bigint as before_,
  sum(weight) over (order by cap::double / weight, rank rows between current row and unbounded following)::bigint as left_ from r2),
r4 as (select *, cap::double <= (share - before_::double) / left_::double * weight::double as clamped from r3),
r5 as (select *, (sum(case when clamped then cap else 0 end) over ())::double as spent,
  (sum(case when clamped then 0 else weight end) over ())::double as open_weight from r4),
s as (select rank, source, source_size,
  case when clamped then cap::double else (share - spent) / nullif(open_weight, 0::double) * weight::double end as target from r5),
k as (select rows.doc_id, rows.size, s.rank, s.source_size, s.target, md5('17:' || coalesce(doc_id::varchar, 'null')) as key
  from rows join s on rows.source is not distinct from s.source),
c as (select *, coalesce(sum(size) over (partition by rank order by key, size rows between unbounded preceding and 1 preceding), 0)::bigint as before_,
  coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as whole from k)
select doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, floor(target)::bigint - whole * source_size - before_)))::bigint as taken from c
"""
