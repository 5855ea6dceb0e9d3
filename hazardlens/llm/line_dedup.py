"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct 5-word shingles. In one global order, rare tokens first, two lines with a Jaccard
similarity of 0.8 or more share a token of both their prefixes; candidates are lines that meet at such a token and pass
the length and positional filters. Whole sets decide. A line goes if an earlier one (by document id, then line number)
is similar; lines are judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.arrowtext import byte_slices, tidy
from hazardlens.llm.exprs import spare
from hazardlens.llm.io import Stash
from hazardlens.llm.jaccard_join import GROWTH, _lists, common_shingles, measured
from hazardlens.llm.regions import partners, regions
from hazardlens.llm.shingles import K, rare_prefixes, shingle_sets

#: Bits of a line's parity sketch at least.
SKETCH = 256


def units_of_lines(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Begins of lines (after each line feed and at each text) and the end."""
    return np.unique(np.concatenate([offsets, np.flatnonzero(raw == 10) + 1]))


def lines(docs: DataFrame, table, similar: int, short: bool = False) -> DataFrame:
    """A row per line of five words or more (with ``short``, of one or more): ``doc_id, row_key, line, n, node, keys, sketch``.

    Lines under five words have no keys: their one shingle is equal only where the node is. ``keys`` are the tokens of the
    line's prefix in their order; they and the sketch go out once a slice for lines that repeat in it.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "row_key", "line", "n", "node", "keys", "sketch"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            for a, b, raw, offsets in byte_slices(batch):
                at = units_of_lines(raw, offsets)
                sets = shingle_sets(raw, at)
                digests = sets.digests()
                doc = np.searchsorted(offsets, at[:-1], "right") - 1
                line = np.arange(len(at) - 1) - np.searchsorted(at, offsets[doc])
                five = sets.words >= K
                use = np.flatnonzero(sets.sizes > 0 if short else five)
                keep = five & _first_of_each(digests)
                unit, h, _ = rare_prefixes(sets, level, similar, keep)
                place = np.full(len(at) - 1, -1)
                place[use] = np.arange(len(use))
                ids = batch.select(["doc_id", "row_key"]).slice(a, b - a).take(pa.array(doc[use]))
                sketch = sets.sketch_array(SKETCH, keep)
                yield pa.RecordBatch.from_arrays(
                    [ids.column(0), ids.column(1), pa.array(line[use]), pa.array(sets.sizes[use]), pa.array(digests[use].view(np.int64)),
                     _lists(h, place[unit], len(use)), sketch.take(pa.array(use))], names)

    schema = f"doc_id {kind}, row_key long, line long, n long, node long, keys array<long>, sketch binary"
    return docs.select("doc_id", "row_key", "text").mapInArrow(tidy(of), schema)


def _first_of_each(digests: np.ndarray) -> np.ndarray:
    out = np.zeros(len(digests), bool)
    out[np.unique(digests, return_index=True)[1]] = True
    return out


def removed_lines(docs: DataFrame, stash: Stash, similar: int = 80, short: bool = False) -> DataFrame:
    """``doc_id, row_key, line`` (from 0) of the lines to remove; ``row_key`` is a 64-bit hash of the text.

    Lines without a word stay. Lines under five words stay too, unless ``short``: then their word sequence is their one
    shingle, and those that repeat an earlier one go. Rows with null ids come first in the order. A
    text that repeats loses its lines in the later rows; in whole rows that repeat, lines count as one occurrence.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    table = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, units_of_lines))
    found = stash.keep(lines(docs, table, similar, short), "lines")
    rank = F.struct("doc_id", "row_key", "line")
    keys = F.first(F.when(F.size("keys") > 0, F.col("keys")), ignorenulls=True).alias("keys")
    classes = found.groupBy("node").agg(F.min(rank).alias("rank"), F.count("*").alias("copies"), F.first("n").cast("int").alias("n"), keys, F.first("sketch", ignorenulls=True).alias("sketch"))
    classes = stash.keep(classes, "classes")
    places = stash.keep(found.select("doc_id", "row_key", "line", "node"), "places")
    stash.drop(found)  # its keys and sketches are in the classes
    met = stash.keep(regions(classes.select("node", "n", F.posexplode("keys").alias("place", "region")), similar), "met")
    sketches = classes.filter("sketch is not null").select("node", "rank", "sketch")
    owner = classes.select("node", F.col("rank.doc_id").alias("doc_id"))
    left, cap = met, 1
    hit = tried = None
    while True:
        step = stash.keep(partners(left.join(sketches, "node"), similar, cap), "level")
        pairs = step.filter("kind = 0").select(F.greatest("earlier", "later").alias("a"), F.least("earlier", "later").alias("b"), "later").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stash.keep(pairs, "pairs")
        if pairs.limit(1).count():
            seen = measured(pairs.select("a", "b"), owner, docs, stash, units_of_lines)
            linked = seen.filter(F.col("both") * 100 >= F.col("either") * similar).select("a", "b")
            new = pairs.join(linked, ["a", "b"]).select(F.col("later").alias("node")).distinct()
            hit = stash.keep(new if hit is None else hit.unionByName(new).distinct(), "hit")
            tried = pairs.select("a", "b") if tried is None else stash.keep(tried.unionByName(pairs.select("a", "b")), "tried")
        still = step.filter("kind = 1").select("region").distinct()
        if hit is None or not still.limit(1).count():
            break
        cap *= GROWTH
        done = hit.withColumn("done", F.lit(True))
        left = met.join(still, "region", "left_semi").join(done, "node", "left").withColumn("seeks", F.col("done").isNull())
        some = left.groupBy("region").agg(F.max("seeks").alias("some")).filter("some").select("region")
        left = stash.keep(left.drop("done").join(some, "region", "left_semi"), "open")
        if not left.limit(1).count():
            break
    # lines that occur once and are similar to no other take no part in the join
    marks = classes.filter("copies > 1").select("node", "rank")
    marks = marks.withColumn("hit", F.lit(None).cast("boolean")) if hit is None else marks.join(hit.withColumn("hit", F.lit(True)), "node", "full_outer")
    again = places.join(marks.hint("shuffle_hash"), "node")
    later = ~(F.col("doc_id").eqNullSafe(F.col("rank.doc_id")) & (F.col("row_key") == F.col("rank.row_key")) & (F.col("line") == F.col("rank.line")))
    out = again.filter(F.col("hit") | later)
    return out.select("doc_id", "row_key", "line")


def without_repeats(docs: DataFrame, stash: Stash, similar: int = 80, short: bool = False, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs``, all columns and rows, its text without the removed lines, plus two columns named by ``counts``: lines, and removed ones.

    Lines end at line feeds; what stays is joined by line feeds again. A null text stays null and has 0 lines; texts
    from which nothing goes are unchanged. With ``short``, lines of one to four words take part. Input columns of
    those names give way to the new ones.
    """
    own = [c for c in docs.columns if c not in counts]
    docs = docs.select(*own)
    doc, key, row_key, mask, removed = spare(docs, "doc", "key", "row_key", "mask", "removed")
    gone = removed_lines(docs, stash, similar, short).groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set(F.col("line").cast("int"))).alias("at"))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("at", i - 1))
    upto = lambda at, i: F.concat(F.array_repeat(F.lit(True), at - before(i) - 1), F.array(F.lit(False)))
    # one flag for each line up to the last that goes, so that the work is in proportion to the lines
    gone = gone.select(F.col("doc_id").alias(doc), F.col("row_key").alias(key), F.flatten(F.transform("at", upto)).alias(mask), F.size("at").alias(removed))
    out = docs.withColumn(row_key, F.xxhash64("text"))
    # the lists are small beside the texts: hashed, so that the texts needn't be sorted
    out = out.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(row_key) == F.col(key)), "left")
    kept = F.zip_with(F.split("text", "\n"), mask, lambda x, stays: F.when(F.coalesce(stays, F.lit(True)), x))
    text = F.when(F.col(mask).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    names = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in own]
    return out.select(*names, n_lines.alias(counts[0]), F.coalesce(removed, F.lit(0)).cast("long").alias(counts[1]))
