"""Search for near sets within regions (rows that share a key), by parity sketches and Voronoi cells.

A sketch is a parity row: two rows differ in no more bits than the sets differ in elements. So the count of differing
bits is a metric that never exceeds the symmetric difference of the sets, and of two sets with a Jaccard similarity of
``similar`` % it is at most ``(100 - similar) / (100 + similar)`` of both sizes together. Regions too large for all pairs
are cut into cells: every row belongs to the cell of its nearest pivot, and by the triangle inequality a partner of it
is within a window of twice the radius of that cell's border. Cells are cut again while that spares work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardlens.llm.arrowtext import tidy

#: Rows of a region up to which all pairs are tested at once, rows from which it is cut into cells, pivots for each cut.
SMALL, CELL, PIVOTS = 64, 512, 16
#: Rows, and bytes with their sketches, worked on at once; a larger region is worked on whole.
CHUNK, CHUNK_BYTES = 50_000, 16 << 20


class Sketches:
    """Parity rows of several widths (powers of two, 32 bytes or more); a row is folded once to meet one of half its width."""

    def __init__(self, rows: list[bytes]):
        self.width = np.array([len(r) for r in rows], np.int64)
        self.level: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():
            at = np.full(len(rows), -1)
            own, twice = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            bits = np.frombuffer(b"".join([rows[i] for i in own]), np.uint64).reshape(len(own), -1)
            if len(twice):
                wide = np.frombuffer(b"".join([rows[i] for i in twice]), np.uint64).reshape(len(twice), -1)
                bits = np.concatenate([bits, folded(wide)])
            at[own], at[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            self.level[w] = bits, at

    def apart(self, i, j) -> np.ndarray:
        """Differing bits of the rows i and j (arrays, or one of them a single row), which differ once in width at most."""
        w, v = self.width[i], self.width[j]
        least = np.minimum(w, v)
        i, j = np.broadcast_arrays(i, j)
        out = np.zeros(len(least), np.int64)
        for w in np.unique(least).tolist():
            use = least == w
            bits, at = self.level[w]
            out[use] = np.bitwise_count(bits[at[i[use]]] ^ bits[at[j[use]]]).sum(axis=1, dtype=np.int64)
        return out

    def narrowest(self, own: np.ndarray) -> np.ndarray:
        """The rows ``own`` folded to the narrowest among them."""
        least = int(self.width[own].min())
        out = np.empty((len(own), least // 8), np.uint64)
        for w in np.unique(self.width[own]).tolist():
            use = self.width[own] == w
            bits, at = self.level[w]
            rows = bits[at[own[use]]]
            while rows.shape[1] * 8 > least:
                rows = folded(rows)
            out[use] = rows
        return out


def folded(rows: np.ndarray) -> np.ndarray:
    """Parity rows of half the width: those for one low bit of the hash less."""
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def pairs_within(at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of rows of one region, of the regions ``at[k]:at[k + 1]`` with ``most`` rows at most."""
    size = np.diff(at)
    left = np.repeat(at[1:], size) - np.arange(int(at[-1]))  # rows from here to the region's end
    left[np.repeat(size, size) > most] = 0
    i = np.flatnonzero(left > 1)
    for d in range(1, most):
        i = i[left[i] > d]
        if not len(i):
            return
        for k in range(0, len(i), 200_000):
            yield i[k : k + 200_000], i[k : k + 200_000] + d


def cells(sketches: Sketches, reach: np.ndarray, core: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells as ``(core, members)``: a row of the one and a partner within its reach are in core and members of one cell.

    ``reach[y]`` bounds the distance from y to a partner. Pivots are chosen far from each other. A region isn't cut where the
    cells with their windows would need more than three quarters of the comparisons.
    """
    if len(members) <= CELL:
        yield core, members
        return
    rows = sketches.narrowest(members)
    pivots, dist = [0], []
    for _ in range(PIVOTS):
        dist.append(np.bitwise_count(rows ^ rows[pivots[-1]]).sum(axis=1, dtype=np.int64))
        nearest = np.min(dist, axis=0)
        pivots.append(int(nearest.argmax()))
    d = np.array(dist)
    home = d.argmin(axis=0)
    within = d - nearest <= 2 * reach[members]
    is_core = np.isin(members, core)
    parts = [(members[(home == q) & is_core], members[within[q]]) for q in range(PIVOTS)]
    if sum(len(c) * len(m) for c, m in parts) > 0.75 * len(core) * len(members):
        yield core, members
        return
    for c, m in parts:
        if len(c):
            yield from cells(sketches, reach, c, m)


def found(at: np.ndarray, n: np.ndarray, sketches: Sketches, possible: Callable, seeks: np.ndarray, similar: int, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(earlier, later, open regions)``: for every row that seeks, its first ``cap`` possible partners among earlier rows.

    Rows are in order within the regions ``at[k]:at[k + 1]``. ``possible(i, j)`` tells which index pairs may be near, by
    all but sketches. A region is open if a row reached ``cap``, so that it may have more.
    """
    size = np.diff(at)

    def near(i, j) -> np.ndarray:
        ok = seeks[j] & (100 * np.minimum(n[i], n[j]) >= similar * np.maximum(n[i], n[j])) & possible(i, j)
        k = np.flatnonzero(ok)
        i, j = (x if np.ndim(x) == 0 else x[k] for x in (i, j))
        ok[k] = sketches.apart(i, j) * (100 + similar) <= (n[i] + n[j]) * (100 - similar)
        return ok

    pairs = []
    for i, j in pairs_within(at, SMALL):
        ok = near(i, j)
        if ok.any():
            pairs.append((i[ok], j[ok]))
    if pairs:
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.lexsort((i, j))
        i, j = i[order], j[order]
        new = np.append(True, j[1:] != j[:-1])
        place = np.arange(len(j)) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(j))))
        more = np.unique(np.searchsorted(at, j[place >= cap], "right") - 1)
        yield i[place < cap], j[place < cap], more
    reach = n * (100 + similar) // similar * (100 - similar) // (100 + similar) + 1
    for k in np.flatnonzero(size > SMALL):
        rows = np.arange(at[k], at[k + 1])
        full = False
        for core, members in cells(sketches, reach, rows[seeks[rows]], rows):
            left, had = core, np.zeros(len(core), np.int64)
            a, b = [], []
            for i in members:
                begin = np.searchsorted(left, i, "right")
                left, had = left[begin:], had[begin:]
                if not len(left):
                    break
                ok = near(i, left)
                if ok.any():
                    a.append(np.full(int(ok.sum()), i))
                    b.append(left[ok])
                    had[ok] += 1
                    stay = had < cap
                    full |= not stay.all()
                    left, had = left[stay], had[stay]
            if a:
                yield np.concatenate(a), np.concatenate(b), np.zeros(0, np.int64)
        if full:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([k])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The sorted rows in chunks of whole groups: about CHUNK rows, or one larger group."""
    held: list[pa.RecordBatch] = []
    size = weight = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        weight += batch.nbytes
        if size < CHUNK and weight < CHUNK_BYTES:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut == 0 and held[0].column(held[0].schema.get_field_index(key))[0].as_py() == keys[-1]:
            continue  # one group so far
        if cut == 0:  # the last group began in an earlier batch
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = whole.column(whole.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            yield whole.slice(0, cut)
            held, size, weight = [whole.slice(cut)], whole.num_rows - cut, 0
            continue
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]).combine_chunks().to_batches()[0]
        held, size, weight = [batch.slice(cut)], batch.num_rows - cut, 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def regions(keyed: DataFrame, similar: int) -> DataFrame:
    """Regions of two sets or more, ``region, node, n, place``; of regions with the same sets one is left.

    ``keyed`` has ``region, node, n, place``, one row for each region that a node is replicated to; ``place`` counts from 0 in
    the order of the set's elements, and the least of a node in equal regions is kept. A set without a neighbour in the
    order of sizes that its own size allows leaves the region; two sets alone in one leave it too if it can't be the first
    that a linked pair has in common, as too few elements follow in either. Sorts and windows spill; nothing is held whole.
    """
    by_size = Window.partitionBy("region").orderBy("own")
    some = keyed.select("region", "node", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("place")).alias("own"))
    around = [f("own", d).over(by_size).alias(c) for f, d, c in ((F.lag, 1, "less"), (F.lead, 1, "more"), (F.lag, 2, "least"), (F.lead, 2, "most"))]
    n, place = lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))
    sizes = lambda small, large: F.coalesce(100 * n(small) >= similar * n(large), F.lit(False))
    rest = lambda x, y: (100 + similar) * F.least(n(x) - place(x), n(y) - place(y)) >= similar * (n(x) + n(y))
    x, less, more = F.col("own"), F.col("less"), F.col("more")
    two = (F.isnull("less") & F.isnull("most")) | (F.isnull("more") & F.isnull("least"))
    near = (sizes(less, x) & (~two | rest(less, x))) | (sizes(x, more) & (~two | rest(x, more)))
    some = some.select("region", "node", "own", *around).filter(near).select("region", "node", n(x).alias("n"), place(x).alias("place"))
    key = lambda seed: F.sum(F.shiftright(F.xxhash64("node", F.lit(seed)), 20)).over(Window.partitionBy("region"))
    same = some.select(F.xxhash64(key(1), key(2)).alias("region"), "node", "n", "place")
    return same.groupBy("region", "node").agg(F.first("n").alias("n"), F.min("place").alias("place"))


def partners(members: DataFrame, similar: int, cap: int) -> DataFrame:
    """``kind`` 0: pairs of nodes that may be near, ``earlier`` and ``later``; ``kind`` 1: ``region`` that may have more.

    ``members`` has ``region, node, n, place, sketch`` and may have ``rank`` (the order; else nodes), ``label`` (rows of one
    label don't look for each other; else nodes) and ``seeks`` (else all do). The positional filter takes the region's key
    for the first element that both sets have: one that isn't is met in another region. Partitions are sorted by Spark and
    read in chunks of whole regions.
    """
    names = ["kind", "region", "earlier", "later"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, "region"):
            col = {c: chunk.column(i) for i, c in enumerate(chunk.schema.names)}
            region, node, n, place = (col[c].to_numpy(zero_copy_only=False) for c in ("region", "node", "n", "place"))
            label, seeks = (col[c].to_numpy(zero_copy_only=False) if c in col else None for c in ("label", "seeks"))
            at = np.append(np.flatnonzero(np.append(True, region[1:] != region[:-1])), len(region))

            def possible(i, j, n=n, label=node if label is None else label, left=n - place) -> np.ndarray:
                least = -(-similar * (n[i] + n[j]) // (100 + similar))
                return (label[i] != label[j]) & (np.minimum(left[i], left[j]) >= least)

            for i, j, more in found(at, n, Sketches(col["sketch"].to_pylist()), possible, np.ones(len(n), bool) if seeks is None else seeks, similar, cap):
                for k in range(0, len(i), 100_000):
                    own = slice(k, k + 100_000)
                    cols = (np.zeros(len(i[own]), np.int64), region[j[own]], node[i[own]], node[j[own]])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names)
                if len(more):
                    zero = np.zeros(len(more), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (zero + 1, region[at[more]], zero, zero)], names)

    rank = "rank" if "rank" in members.columns else "node"
    wanted = [c for c in ("region", "node", "n", "place", "sketch", "label", "seeks") if c in members.columns]
    dealt = members.repartition("region").sortWithinPartitions("region", rank).select(*wanted)
    return dealt.mapInArrow(tidy(deal), "kind long, region long, earlier long, later long")
