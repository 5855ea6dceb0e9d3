"""N-gram Jaccard join in the metric space of shingle sets.

The distance ``1 - J`` is a metric, so pivots, their regions and triangle-inequality windows give an exact join. Random
document pivots alone don't scale on text: unrelated texts are all at distance 1 of each other, every document is then
within the window of every region, and all are replicated everywhere. So the regions of the first level have the
smallest possible pivots, sets of one shingle: a document is at distance below 1 of such a pivot only if it has the
shingle. Of the regions that it touches it is replicated to the boundary that pairs within the radius need: those of its
first ``n - ceil(0.8 n) + 1`` shingles in one global order, rare ones first. Two documents within the radius meet there.
Regions with the same documents are one.

Within a region (see ``regions.py``) documents are pivots: they create cells, windows of the triangle inequality replicate
documents at the borders, and cells are joined recursively. Distances there come from parity sketches, a map into Hamming
space that lengthens no distance, so no link is lost. Each document proposes its first partner in the order of nodes; whole
sets decide. Once the links found make components, only documents of different components go on, with more partners
each, in regions where some are left. So a group of copies costs about a pair for each of its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.arrowtext import byte_slices, tidy
from hazardlens.llm.components import labels
from hazardlens.llm.exprs import spare
from hazardlens.llm.io import Stash
from hazardlens.llm.regions import partners, regions
from hazardlens.llm.shingles import COMMON, SLOTS_LOG2, Sets, rare_prefixes, rarity_table, shingle_sets, shingles

#: Partners that a row of a region proposes: one in the first round, so many times as many in each further one.
GROWTH = 8
#: Shingles are called common from this count in a block of BLOCK shingles on, and in all.
IN_BLOCK, IN_ALL, BLOCK = 4, 32, 1 << 21
#: Bits of a set's parity sketch at least; larger sets have larger ones.
SKETCH = 256
#: Slots of the fixed-size bitmap (8 MB) that spares unneeded texts before an exact join.
BITS_LOG2 = 26


def units_of_texts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return offsets


def common_shingles(texts: DataFrame, units=units_of_texts) -> bytes:
    """The rarity table of all shingles of the column ``text``, repeats within a unit counted; counts go through one aggregation, 2**18 rows come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            h = np.concatenate(held)
            slot = (h >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
            h = h[np.bincount(slot)[slot] >= IN_BLOCK]  # the others can't be as frequent, and needn't be sorted
            h, c = np.unique(h, return_counts=True)
            some = c >= IN_BLOCK
            return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(c[some])], ["h", "n"])

        for batch in batches:
            for _, _, raw, offsets in byte_slices(batch):
                held.append(shingles(raw, units(raw, offsets))[0])
                n += len(held[-1])
                if n >= BLOCK:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    counts = texts.select("text").mapInArrow(tidy(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= IN_ALL).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    return rarity_table(list(zip(top["h"].to_pylist(), top["n"].to_pylist(), strict=True)))


def _lists(values: np.ndarray, unit: np.ndarray, n: int) -> pa.Array:
    at = np.searchsorted(unit, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64)))


def nodes(docs: DataFrame, table, similar: int) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``row_key``, ``text``): the set's size, its digest ``node`` and its region keys."""
    kind = dict(docs.dtypes)["doc_id"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            for a, b, raw, offsets in byte_slices(batch):
                sets = shingle_sets(raw, offsets)
                unit, h, _ = rare_prefixes(sets, level, similar)
                ids = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [ids.column(0), ids.column(1), pa.array(sets.sizes.astype(np.int64)), pa.array(sets.digests().view(np.int64)), _lists(h, unit, b - a), sets.sketch_array(SKETCH)],
                    ["doc_id", "row_key", "n", "node", "keys", "sketch"],
                )

    return docs.select("doc_id", "row_key", "text").mapInArrow(tidy(of), f"doc_id {kind}, row_key long, n long, node long, keys array<long>, sketch binary")


def _bitmap(slots: DataFrame) -> bytes:
    """A bit for each value of ``slot`` (0 to 2**26 - 1); the driver gets at most 2**20 words of 64 bits."""
    bit = F.expr("shiftleft(1L, cast(pmod(slot, 64) as int))")
    got = slots.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(bit).alias("v")).toArrow()
    out = np.zeros(1 << (BITS_LOG2 - 6), np.int64)
    out[got["w"].to_numpy()] = got["v"].to_numpy()
    return out.tobytes()


def _in_bitmap(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1


def measured(pairs: DataFrame, classes: DataFrame, docs: DataFrame, stash: Stash, units=units_of_texts) -> DataFrame:
    """``a, b, both, either``: sizes of intersection and union of the whole sets of each pair of nodes.

    ``classes`` has ``node, doc_id``: a document that has the node's text (or line). Bitmaps of fixed size let pass the
    documents and sets that may be needed; a join by node then takes those that are.
    """
    spark = docs.sparkSession
    n_slots = 1 << BITS_LOG2
    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    need = stash.keep(classes.select("node", "doc_id").join(need, "node"), "need")
    doc_slot = F.pmod(F.xxhash64("doc_id"), F.lit(n_slots))
    doc_bits = spark.sparkContext.broadcast(_bitmap(need.select(doc_slot.alias("slot"))))
    node_bits = spark.sparkContext.broadcast(_bitmap(need.select(F.pmod("node", F.lit(n_slots)).alias("slot"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_docs, of_nodes = (np.frombuffer(x.value, np.int64) for x in (doc_bits, node_bits))
        for batch in batches:
            batch = batch.filter(pa.array(_in_bitmap(of_docs, batch.column(0).to_numpy(zero_copy_only=False))))
            for _, _, raw, offsets in byte_slices(batch):
                found: Sets = shingle_sets(raw, units(raw, offsets))
                node = found.digests().view(np.int64)
                full = np.flatnonzero((found.sizes > 0) & _in_bitmap(of_nodes, node & (n_slots - 1)))
                _, one = np.unique(node[full], return_index=True)
                full = full[one]
                yield pa.RecordBatch.from_arrays([pa.array(node[full]), pa.array([found.of(i).tobytes() for i in full], pa.binary())], ["node", "set"])

    texts = docs.select(doc_slot.alias("slot"), "text")
    own = texts.mapInArrow(tidy(sets), "node long, set binary").join(need.select("node"), "node", "left_semi").dropDuplicates(["node"])
    own = stash.keep(own, "sets")
    a, b = (own.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}")) for k in ("a", "b"))

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                k = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                both.append(k)
                either.append(len(x) + len(y) - k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "either"])

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")
    out = stash.keep(joined.mapInArrow(tidy(overlap), "a long, b long, both long, either long"), "measured")
    stash.drop(own, need)
    return out


def _of_several_labels(members: DataFrame) -> DataFrame:
    """Rows of the regions with more than one label; in others all are linked already."""
    ends = members.groupBy("region").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    return members.join(ends.filter("a <> b").select("region"), "region", "left_semi")


def groups(docs: DataFrame, stash: Stash, similar: int = 80, whole_rows: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, row_key, n_shingles, node, label, component_id``; ``label`` names the group whatever its ids (null without words).

    Rows link when their shingle sets have a Jaccard similarity of ``similar`` % or more; ``component_id`` is the
    smallest id reachable. Equal sets are one node, so copies are compared once. Texts without words (null, empty,
    blank) link with nothing: component_id is their own id, also where such rows repeat. Ids may repeat: rows with
    one text are then one node, others are told apart by text (``row_key`` is a 64-bit hash of the text, with ``whole_rows``
    of all columns). An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64(*(docs.columns if whole_rows else ["text"])).alias("row_key"), "text")
    table = spark.sparkContext.broadcast(common_shingles(docs))
    rows = stash.keep(nodes(docs, table, similar), "nodes")
    full = rows.filter("n > 0")
    keyed = full.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    keyed = keyed.select(F.posexplode("keys").alias("place", "region"), "node", F.col("n").cast("int").alias("n"))
    sketched = full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stash.keep(sketched, "classes")
    met = stash.keep(regions(keyed, similar), "met")
    stash.release()
    sketches = classes.select("node", "sketch")
    left, cap = met, 1
    links = label = tried = None
    while True:
        step = stash.keep(partners(left.join(sketches, "node"), similar, cap), "level")
        stash.release()
        pairs = step.filter("kind = 0").select(F.greatest("earlier", "later").alias("a"), F.least("earlier", "later").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stash.keep(pairs, "pairs")
        if pairs.limit(1).count():
            seen = measured(pairs, classes, docs, stash)
            new = seen.filter(F.col("both") * 100 >= F.col("either") * similar).select("a", "b")
            links = new if links is None else stash.keep(links.unionByName(new), "links")
            label = stash.keep(labels(links, stash), "label")
            stash.release()
            tried = pairs if tried is None else stash.keep(tried.unionByName(pairs), "tried")
        still = step.filter("kind = 1").select("region").distinct()
        if label is None or not still.limit(1).count():
            break
        cap *= GROWTH
        open_ones = met.join(still, "region", "left_semi").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        left = stash.keep(_of_several_labels(open_ones), "open")
        if not left.limit(1).count():
            break
    if label is None:
        named = classes.select("node", "doc_id", F.col("node").alias("label"))
    else:
        named = classes.join(label, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(least, "label").select("node", "label", "component_id")
    out = rows.select("doc_id", "row_key", F.col("n").alias("n_shingles"), "node").join(of_node, "node", "left")
    return out.select("doc_id", "row_key", "n_shingles", "node", "label", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, stash: Stash, similar: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of which each group of linked documents keeps its smallest id.

    Groups are told apart by their texts, so unlinked texts without an id, or of one id, all stay; a null id counts as
    the largest. Of rows with one id and equal words, the one with the smallest hash of all columns stays; whole rows that
    repeat count as copies. Texts without words all stay (a repeated row once). Any other columns are kept as they are.
    """
    found = stash.keep(groups(docs, stash, similar, whole_rows=True), "groups")
    name, key = spare(docs, "name", "key")
    ids = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(name)
    blank = found.filter("n_shingles = 0").select(ids("doc_id"), F.col("row_key").alias(key))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row_key"))
    best = found.filter("n_shingles > 0").groupBy("label").agg(first.alias("f")).select(ids("f.doc_id"), F.col("f.row_key").alias(key))
    best = best.unionByName(blank).distinct()
    out = docs.withColumns({name: F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), key: F.xxhash64(*docs.columns)})
    out = out.join(best.hint("shuffle_hash"), [name, key], "left_semi")
    if found.groupBy("doc_id", "row_key").count().filter("count > 1").limit(1).count():  # whole rows repeat
        out = out.dropDuplicates([name, key])
    return out.select(*docs.columns)
