"""Suffix dedup: bytes covered by a string of 50 bytes that an earlier document has too.

Suffixes are sorted where it matters. Every 50-byte window has an anchor, the 20-byte string in it with the least hash;
equal windows have equal anchors at equal places, and consecutive windows mostly share one (a segment, about 16 windows).
A first pass finds the anchors that occur in two documents (by hash; false positives do no harm). A second one sorts the
suffixes that begin at those anchors, each with the reversed bytes before it, into runs, front-codes them (length of the
prefix shared with the one before, and the rest), and deals the runs out by anchor. Runs are merged by loser trees that
carry common-prefix lengths along, so that no known prefix is compared again. Equal suffixes come out adjacent; those of
one anchor too, where the segments' windows that differ at the ends are compared one by one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.arrowtext import byte_slices, tidy
from hazardlens.llm.io import Stash
from hazardlens.llm.jaccard_join import BITS_LOG2, _bitmap, _in_bitmap
from hazardlens.llm.shingles import mixed

WIDTH, K = 50, 20
SPAN = WIDTH - K + 1  # anchors that a window chooses from
#: Fixed sizes: bits of the table of repeated anchors (16 MB), parts that anchors are dealt out by at least.
TABLE_LOG2, PARTS_LOG2 = 27, 6
#: A run ends beyond so many bytes of text or suffixes.
RUN_BYTES, RUN_SUFFIXES = 32 << 20, 1 << 19
FIRST_ID = -(2**63)  # of rows without an id
_ODD = np.uint64(0x9FB21C651E98DF25)
_LOW32 = np.uint64(0xFFFFFFFF)


def anchored(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of the texts ``raw[offsets[i]:offsets[i + 1]]``: text, first window, last window, anchor, its 64-bit hash."""
    none = np.zeros(0, np.int64)
    n = len(raw)
    if n < WIDTH:
        return none, none, none, none, none.astype(np.uint64)
    h = raw.astype(np.uint64)
    wide = 1  # h[i] describes raw[i:i + wide]
    for step in (1, 2, 4, 8):  # to 16 bytes, then to 20
        h = mixed(h[:-step] * _ODD + h[step:])
        wide += step
    four = mixed(mixed(raw[:-3].astype(np.uint64) * _ODD + raw[1:-2].astype(np.uint64) * np.uint64(257)) + raw[2:-1].astype(np.uint64) * _ODD + raw[3:].astype(np.uint64))
    h = mixed(h[: n - K + 1] * _ODD + four[16 : n - K + 1 + 16])
    low = (h & ~_LOW32) | np.arange(len(h), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: n - WIDTH + 1], low[SPAN - 16 : SPAN - 16 + n - WIDTH + 1])
    at = np.arange(n - WIDTH + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    ok = at + WIDTH <= offsets[text + 1]
    at, text, anchor = at[ok], text[ok], (low[ok] & _LOW32).astype(np.int64)
    if not len(at):
        return none, none, none, none, none.astype(np.uint64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    # anchors have small hashes; mixed again, their top bits spread over all parts and slots alike
    return text[first], at[first], at[last], anchor[first], mixed(h[anchor[first]] * _ODD)


def repeated_anchors(texts: DataFrame, reps: bytes) -> bytes:
    """Bit table, by the top bits of an anchor's hash, of those in two documents or more."""
    held = texts.sparkSession.sparkContext.broadcast(reps)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0
        for raw, offsets, _, _ in _of_reps(batches, held):
            text, _, _, _, h = anchored(raw, offsets)
            h >>= np.uint64(18)  # top 46 bits: the part's 6 and 40 more
            order = np.lexsort((h, text)) if len(offsets) > 2 else np.argsort(h)
            h, text = h[order], text[order]
            own.append(h[np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))] if len(h) else h)  # once a text
            size += len(own[-1])
            if size >= RUN_SUFFIXES:
                yield dealt(own)
                own, size = [], 0
        if size:
            yield dealt(own)

    def dealt(own: list[np.ndarray]) -> pa.RecordBatch:
        h, counts = np.unique(np.concatenate(own), return_counts=True)
        h = np.repeat(h, np.minimum(counts, 2))
        part = (h >> np.uint64(40)).astype(np.int64)
        at = np.searchsorted(part, np.arange((1 << PARTS_LOG2) + 1))
        five = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :5]
        some = np.flatnonzero(np.diff(at))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([five[at[p] : at[p + 1]].tobytes() for p in some], pa.binary())], ["part", "run"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for p, run in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own.setdefault(p, []).append(np.frombuffer(run.as_buffer(), np.uint8).reshape(-1, 5))
        for p, runs in own.items():
            five = np.concatenate(runs)
            h = np.zeros((len(five), 8), np.uint8)
            h[:, :5] = five
            h = np.sort(h.view(np.uint64).ravel())
            slot = (h[1:][h[1:] == h[:-1]] >> np.uint64(40 + PARTS_LOG2 - TABLE_LOG2)).astype(np.int64)
            bits = np.zeros(1 << (TABLE_LOG2 - PARTS_LOG2), np.uint8)
            bits[slot] = 1
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])

    runs = texts.mapInArrow(tidy(gather), "part int, run binary").repartition("part")
    pieces = {r["part"]: r["bits"] for r in runs.mapInArrow(tidy(pick), "part int, bits binary").toLocalIterator()}
    blank = bytes(1 << (TABLE_LOG2 - PARTS_LOG2 - 3))
    return b"".join(bytes(pieces.get(p, blank)) for p in range(1 << PARTS_LOG2))


def _of_reps(batches, held) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, ids and row keys of texts whose slot is in the bitmap."""
    wanted = np.frombuffer(held.value, np.int64)
    for batch in batches:
        batch = batch.filter(pa.array(_in_bitmap(wanted, batch.column(0).to_numpy(zero_copy_only=False))))
        for a, b, raw, offsets in byte_slices(batch):
            ids, keys = (batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in (1, 2))
            yield raw, offsets, ids, keys


def sorted_runs(texts: DataFrame, reps: bytes, repeated: bytes, log2: int) -> DataFrame:
    """``part, run``: front-coded sorted runs of the suffixes at repeated anchors, and spans that a run settles by itself.

    Parts are by anchor, about four for each shuffle partition, so that what a task merges at once stays small. Of equal
    keys only those of a run's least document are dealt out; the other documents lose the whole segment. So a passage that
    very many documents share goes to the task of its anchors once a run. Rows of settled spans have parts from 2**log2 on,
    and go to any task.
    """
    spark = texts.sparkSession
    held, table = spark.sparkContext.broadcast(reps), spark.sparkContext.broadcast(repeated)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)
        keys, ids, rows, size, docs, suffixes = [], [], [], 0, 0, 0
        for raw, offsets, doc, row in _of_reps(batches, held):
            text, first, last, anchor, h = anchored(raw, offsets)
            slot = (h >> np.uint64(64 - TABLE_LOG2)).astype(np.int64)
            use = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
            text, first, last, anchor = text[use], first[use], last[use], anchor[use]
            part = (h[use] >> np.uint64(64 - log2)).astype(np.uint32)
            keys.append((_keys(raw, first, last, anchor), part, (text + docs).astype(np.uint32), (first - offsets[text]).astype(np.uint32)))
            ids.append(doc)
            rows.append(row)
            size += len(raw)
            docs += len(doc)
            suffixes += len(text)
            if size >= RUN_BYTES or suffixes >= RUN_SUFFIXES:
                yield from _front_coded(keys, np.concatenate(ids), np.concatenate(rows), 1 << log2)
                keys, ids, rows, size, docs, suffixes = [], [], [], 0, 0, 0
        if keys:
            yield from _front_coded(keys, np.concatenate(ids), np.concatenate(rows), 1 << log2)

    return texts.mapInArrow(tidy(build), "part int, run binary").repartition(1 << log2, "part").sortWithinPartitions("part")


#: Runs are packed one by one; what is front-coded is text, which packs to less than half.
_pack, _unpack = zstandard.ZstdCompressor(level=4), zstandard.ZstdDecompressor()
#: A key: the anchor, lengths of the rest after it and of what is before it, the rest, and the reversed bytes before.
LONGEST = K + 2 + 2 * (WIDTH - K)


def _keys(raw: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    n = len(first)
    out = np.zeros((n, LONGEST), np.uint8)
    if not n:
        return out
    after, before = last + WIDTH - anchor - K, anchor - first
    padded = np.append(raw, np.zeros(2 * WIDTH, np.uint8))
    out[:, :K] = padded[anchor[:, None] + np.arange(K)]
    out[:, K], out[:, K + 1] = after, before
    column = np.arange(LONGEST - K - 2)
    right = column < after[:, None]
    left = ~right & (column < (after + before)[:, None])
    at = np.where(right, anchor[:, None] + K + column, anchor[:, None] - 1 - (column - after[:, None]))
    out[:, K + 2 :] = np.where(right | left, padded[np.where(right | left, at, 0)], 0)
    return out


def _front_coded(held: list[tuple], ids: np.ndarray, rows: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    key, part, text, start = (np.concatenate([x[i] for x in held]) for i in range(4))
    if not len(key):
        return
    order = np.argsort(key.view(f"S{LONGEST}").ravel(), kind="stable")
    order = order[np.lexsort((ids[text[order]], _numbers(key[order]), part[order]))]
    key, part, text, start = key[order], part[order], text[order], start[order]
    new = np.append(True, (key[1:] != key[:-1]).any(axis=1))
    least = ids[text][np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    rest = ids[text] > least
    if rest.any():
        t, b = text[rest], start[rest].astype("<i8")
        size = key[rest, K].astype(np.int64) + key[rest, K + 1] + K
        spans = np.stack([ids[t].astype("<i8"), rows[t].astype("<i8"), b, b + size])
        for k in range(0, spans.shape[1], 50_000):
            own = np.ascontiguousarray(spans[:, k : k + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array([parts + int(own[1, 0] % parts)], pa.int32()), pa.array([_pack.compress(own.tobytes())], pa.binary())], ["part", "run"])
    key, part, text, start = key[~rest], part[~rest], text[~rest], start[~rest]
    at = np.searchsorted(part, np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(at)):
        k = key[at[p] : at[p + 1]]
        full = K + 2 + k[:, K].astype(np.int64) + k[:, K + 1]
        differs = k[1:] != k[:-1]
        lcp = np.append(0, np.where(differs.any(axis=1), differs.argmax(axis=1), full[1:]))
        lcp = np.minimum(lcp, full)
        column = np.arange(LONGEST)
        rest = k[(column >= lcp[:, None]) & (column < full[:, None])]
        own, text_at = np.unique(text[at[p] : at[p + 1]], return_inverse=True)
        columns = (lcp.astype(np.uint8), full.astype(np.uint8), _planes(text_at, "<u4"), _planes(start[at[p] : at[p + 1]], "<u4"), _planes(np.diff(ids[own], prepend=0), "<i8"), _planes(rows[own], "<i8"), rest)
        out.append((p, _pack.compress(struct.pack("<QQ", len(k), len(own)) + b"".join(x.tobytes() for x in columns))))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["part", "run"])


def _planes(values: np.ndarray, kind: str) -> np.ndarray:
    """The lowest bytes of all values, then the next ones and so on, so that alike bytes are packed together."""
    values = np.ascontiguousarray(values.astype(kind))
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)


def _numbers(sorted_keys: np.ndarray) -> np.ndarray:
    """The same number for equal keys, ascending."""
    return np.cumsum(np.append(False, (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1)))


def _decoded(run: bytes):
    """``(key, lcp with the one before, id, row key, start)`` of each suffix of a run."""
    n, docs = struct.unpack_from("<QQ", run)
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize
        got = np.frombuffer(run, np.uint8, count * size, at).reshape(size, count).T
        at += count * size
        return np.ascontiguousarray(got).view(kind).ravel()

    lcp, full, text, start = (take(kind, n).tolist() for kind in ("u1", "u1", "<u4", "<u4"))
    ids, rows = np.cumsum(take("<i8", docs)).tolist(), take("<i8", docs).tolist()
    key = b""
    for i in range(n):
        same = lcp[i]
        rest = full[i] - same
        if rest or same != len(key):
            key = key[:same] + run[at : at + rest]
            at += rest
        t = text[i]
        yield key, same, ids[t], rows[t], start[i]


def merged(runs: list[bytes]) -> Iterator[tuple[int, bytes, int, int, int]]:
    """``(lcp with the one before, key, id, row key, start)`` of all suffixes in order, by a loser tree.

    A loser keeps the length of the prefix that it shares with the winner that beat it. Of two candidates, the one
    that shares more with the last winner is smaller; only if both share as much are they compared, from there on.
    """
    sources = [_decoded(r) for r in runs]
    heads = [next(s, None) for s in sources]
    k = 1
    while k < len(heads):
        k *= 2
    heads += [None] * (k - len(heads))
    lcp = [0] * k
    tree = [0] * k  # losers; tree[0] is the winner

    def duel(x: int, y: int) -> tuple[int, int]:
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        p, q = lcp[x], lcp[y]
        if p != q:
            return (x, y) if p > q else (y, x)
        s, t = a[0], b[0]
        if s == t:
            lcp[y] = len(s)
            return x, y
        n = min(len(s), len(t))
        while p < n and s[p] == t[p]:
            p += 1
        if s[p:] < t[p:]:
            lcp[y] = p
            return x, y
        lcp[x] = p
        return y, x

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, tree[node] = duel(build(2 * node), build(2 * node + 1))
        return win

    winner = build(1) if k > 1 else 0
    while (top := heads[winner]) is not None:
        yield lcp[winner], top[0], top[2], top[3], top[4]
        head = heads[winner] = next(sources[winner], None)
        if head is not None:
            lcp[winner] = head[1]
        node = (winner + k) >> 1
        while node:
            winner, tree[node] = duel(winner, tree[node])
            node >>= 1


def _resolved(group: list[tuple[bytes, list[tuple[int, int, int]]]]) -> Iterator[tuple[int, int, int, int]]:
    """Removed spans ``(id, row key, begin, end)`` of the segments of one anchor: distinct keys and who has them."""
    group = [(min(held)[0], key, held) for key, held in group]
    for least, key, held in group:
        size = len(key) - 2
        for doc, row, start in held:
            if doc > least:
                yield doc, row, start, start + size
    if len(group) < 2:
        return
    seen: dict[bytes, int] = {}
    for least, key, held in sorted(group, key=lambda x: x[0]):
        after, before = key[K], key[K + 1]
        whole = key[K + 2 + after :][::-1] + key[:K] + key[K + 2 : K + 2 + after]
        own = [(doc, row, start) for doc, row, start in held if doc == least]
        begin = None
        windows = len(whole) - WIDTH + 1
        for i in range(windows + 1):
            gone = i < windows and seen.setdefault(whole[i : i + WIDTH], least) < least
            if gone and begin is None:
                begin = i
            elif not gone and begin is not None:
                for doc, row, start in own:
                    yield doc, row, start + begin, start + i - 1 + WIDTH
                begin = None


def removed_spans(runs: DataFrame, parts: int) -> DataFrame:
    """``id, row_key, begin, end`` (bytes) from the merged runs of each part below ``parts``, and settled ones; spans may overlap."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "row_key", "begin", "end"]
        out: list[tuple[int, int, int, int]] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
        for part, own in _parts(batches):
            if part >= parts:
                for run in own:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(run, "<i8").reshape(4, -1)], names)
                continue
            group: list[tuple[bytes, list]] = []
            for same, key, doc, row, start in merged(own):
                if same < K and group:
                    if len(group) > 1 or len(group[0][1]) > 1:
                        out += _resolved(group)
                    group = []
                if group and same == len(key) == len(group[-1][0]):
                    group[-1][1].append((doc, row, start))
                else:
                    group.append((key, [(doc, row, start)]))
                if len(out) > 50_000:
                    yield flush()
                    out = []
            out += _resolved(group) if group else []
        if out:
            yield flush()

    return runs.mapInArrow(tidy(merge), "id long, row_key long, begin long, end long")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Each part with its unpacked runs; rows come sorted by part, and one part is held at a time."""
    part, own = None, []
    for batch in batches:
        for p, run in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if own and p != part:
                yield part, own
                own = []
            part = p
            own.append(_unpack.decompress(run.as_buffer()))
    if own:
        yield part, own


def without_repeats(docs: DataFrame, stash: Stash) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept (binary)``.

    A byte goes if it is covered by a 50-byte string that also starts in a document with a smaller ``doc_id``; strings
    are judged on the input. Null text counts as empty; texts under 50 bytes stay whole. A row without an id comes before
    all others. Rows with the same id are one document and never take from each other. An empty table gives an
    empty result; other columns are not read. Equal texts are searched once, under their smallest id.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", key.alias("id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    narrow = stash.keep(docs.select("id", "row_key", F.octet_length("text").alias("n"), F.unhex(F.sha2("text", 256)).alias("digest")).filter(F.col("n") >= WIDTH), "digests")
    least = narrow.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << BITS_LOG2))
    reps = _bitmap(least.select(F.pmod(F.xxhash64("least"), F.lit(1 << BITS_LOG2)).alias("slot")))
    several = least.filter("copies > 1").select("digest", "least")
    copies = narrow.join(several, "digest").filter(F.col("id") > F.col("least"))
    copies = copies.select("id", "row_key", F.lit(0).cast("long").alias("begin"), F.col("n").cast("long").alias("end"))
    texts = docs.filter(F.octet_length("text") >= WIDTH).select(slot.alias("slot"), "id", "row_key", "text")
    log2 = max(PARTS_LOG2, (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    runs = sorted_runs(texts, reps, repeated_anchors(texts, reps), log2)
    spans = stash.keep(removed_spans(runs, 1 << log2).unionByName(copies), "spans")
    per_row = spans.groupBy("id", "row_key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    joined = docs.join(per_row.hint("shuffle_hash"), ["id", "row_key"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans.begin", "spans.end")
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, begin, end in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = raw.as_py()
                if not begin.is_valid:
                    rows.append((len(raw), 0, 0, raw))
                    continue
                kept, at, gone, n = [], 0, -1, 0
                for b, e in sorted(zip(begin.as_py(), end.as_py(), strict=True)):
                    if b > gone:  # a new run of removed bytes; one that begins where the last ends continues it
                        kept.append(raw[at:b])
                        n += 1
                    gone = max(gone, e)
                    at = gone
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), n, kept))
            for i in range(0, len(rows), 500):
                own = list(zip(*rows[i : i + 500], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 500), *[pa.array(c, pa.int64()) for c in own[:3]], pa.array(own[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(tidy(cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
