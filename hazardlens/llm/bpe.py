"""Byte-level BPE encoding and decoding over a table of byte strings and their ranks.

A pre-token's merges are scheduled by a rank queue: one bucket for each merge rank holds the positions (nodes of a
doubly linked list of tokens) whose token and successor merge with that rank, and a bitmap hierarchy over the ranks
finds the lowest rank in use by find-first-set. Entries whose tokens have changed since are skipped when they come up.
So a pre-token of n bytes takes O(n) merges at constant cost each, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from struct import Struct, pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hazardlens.llm.arrowtext import kept, tidy

one = Struct("<I").pack
#: Distinct pre-tokens of a generation, of which a worker remembers two (some 150 MB at most), and the longest that is
#: remembered (in characters); others are encoded anew.
REMEMBERED, LONGEST = 350_000, 64
BIT = [1 << b for b in range(256)]
#: The white space of the Unicode standard, which the pattern's \s stands for.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class BytePairs:
    """``ranks``: byte string to id; the id is the merge rank, as in tiktoken's files. All 256 single bytes must be in it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(pattern.replace("[^\\s", f"[^{WHITE}").replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]"))
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: merge the leftmost pair of the lowest rank until none is left.

        ``buckets[r]`` has the positions whose pair merges with rank ``r``, smallest first. Bit ``r % 256`` of
        ``words[r // 256]`` is set while that bucket has any, and bit ``w`` of ``top`` while ``words[w]`` isn't 0.
        """
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # of the token that begins here; 0 where none begins
        prev = list(range(-1, n - 1))
        ids = [self.single[b] for b in piece]
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of each token and its successor; -1 where they don't merge
        pair.append(-1)
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        fresh = [x for x in enumerate(pair) if x[1] >= 0]
        while True:
            for i, rank in fresh:
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    w = rank >> 8
                    if w in words:
                        words[w] |= BIT[rank & 255]
                    else:
                        words[w] = BIT[rank & 255]
                        top |= 1 << w
            if not top:
                break
            w = (top & -top).bit_length() - 1  # find first set, twice
            bits = words[w]
            low = bits & -bits
            rank = w << 8 | low.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                if bits == low:
                    del words[w]
                    top &= top - 1
                else:
                    words[w] = bits ^ low
            fresh = []
            if pair[i] != rank:
                continue  # stale: a pair's bytes only grow, so no rank comes back to a position
            ids[i] = rank
            j = end[i]
            k = end[i] = end[j]
            end[j] = 0
            pair[i] = pair[j] = -1
            if k < n:
                prev[k] = i
                if (rank := get(piece[i : end[k]])) is not None:
                    pair[i] = rank
                    fresh.append((i, rank))
            if i:
                h = prev[i]
                if (rank := get(piece[h:k])) is not None:
                    pair[h] = rank
                    fresh.append((h, rank))
                else:
                    pair[h] = -1
        return [x for x, e in zip(ids, end, strict=True) if e]

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if len(self.known) >= REMEMBERED:  # what wasn't met since the last time goes
            self.known, self.before = {}, self.known
        known, parts = self.known, []
        get, older = known.get, self.before.get
        for token in self.pattern.findall(text):
            ids = get(token)
            if ids is None:
                ids = older(token)
                if ids is None:
                    ids = pack("<%dI" % len(own), *own) if len(own := self.merged(token.encode())) != 1 else one(own[0])
                if len(token) <= LONGEST and len(known) < REMEMBERED:
                    known[token] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def coder(name: str, pattern: str, blob: bytes) -> BytePairs:
    """One per vocabulary, kept for the worker's next tasks of it; what it remembers is bounded (see REMEMBERED)."""

    def load() -> BytePairs:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}
        return BytePairs(ranks, pattern)

    return kept((name, pattern), load)


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id, ids (binary, little-endian uint32), decoded (binary)``.

    Null text counts as empty: no ids. Ties can't arise, as ranks are unique and the leftmost pair goes first; repeated
    rows give repeated results; an empty table gives an empty one; other columns are not read. The vocabulary
    file (under 1 MB, read once on the driver) is broadcast; no shuffle.
    """
    return _mapped(docs, ranks_path, pattern, "ids binary, decoded binary", lambda ids, raw: (ids, raw), (pa.binary(), pa.binary()))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encoded``, taken where the ids are made."""

    def row(ids: bytes, raw: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()

    return _mapped(docs, ranks_path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, (pa.int64(), pa.string(), pa.string()))


def _mapped(docs: DataFrame, ranks_path: str, pattern: str, schema: str, row, types) -> DataFrame:
    with open(ranks_path, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", *[x.split()[0] for x in schema.split(", ")]]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = coder(ranks_path, pattern, blob.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1):
                    ids = pairs.encode(text.as_py() or "")
                    rows.append(row(ids, pairs.decode(ids)))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    return docs.select("doc_id", "text").mapInArrow(tidy(of, (ranks_path, pattern)), f"doc_id {kind}, {schema}")
