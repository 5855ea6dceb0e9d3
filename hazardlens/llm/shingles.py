"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays.

Words are maximal runs without blanks and the control characters 9 to 13; A-Z count as a-z. A unit (a text or a line)
has the set of its distinct 5-word shingles; with fewer words, its whole word sequence as the one shingle; without
words, nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

K = 5
_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _BYTE[_LOWER]
_BASE = int(_rng.integers(1, 2**60)) * 8 + 5
_UNBASE = pow(_BASE, -1, 2**64)
_PLACE = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(1, 2**62, K + 1)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash are usable."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers are kept between calls up to so many; those for longer texts are given back.
KEPT_POWERS = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and its inverse's, modulo 2**64."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_BASE, _UNBASE):
        p = np.full(max(n, 1 << 16), np.uint64(base), np.uint64)
        p[0] = 1
        made.append(np.cumprod(p))
    if n <= KEPT_POWERS:
        _powers[:] = made
    return made[0][:n], made[1][:n]


@dataclass
class Sets:
    """Shingle sets of units 0..n-1: ``hashes`` sorted within each unit, unit ``i`` at ``starts[i]:starts[i + 1]``, of ``words[i]`` words."""

    hashes: np.ndarray
    unit: np.ndarray
    starts: np.ndarray
    words: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.starts[i] : self.starts[i + 1]]

    def digests(self) -> np.ndarray:
        """A 64-bit hash of each whole set (0 for an empty one)."""
        out = np.zeros(len(self.starts) - 1, np.uint64)
        full = np.flatnonzero(self.sizes)
        if len(full):
            sums = np.add.reduceat(mixed(self.hashes + np.uint64(0x9E3779B97F4A7C15)), self.starts[full])
            out[full] = mixed(sums + self.sizes[full].astype(np.uint64) * _PLACE[0]) | np.uint64(1)
        return out

    def sketches(self, least: int, only: np.ndarray | None = None) -> list[bytes | None]:
        return self.sketch_array(least, only).to_pylist()

    def sketch_array(self, least: int, only: np.ndarray | None = None) -> pa.Array:
        """A parity row for each set, as bytes: whether an odd number of shingles has each value of the hash's low bits.

        Two rows of equal width differ in no more bits than the sets differ in elements. A row has ``least`` bits, or for larger
        sets the power of two from their size on. Sets that are not among ``only`` have none.
        """
        n = self.sizes
        bits = np.maximum(least, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
        if only is not None:
            bits[~only] = 0
        at = np.append(0, np.cumsum(bits >> 3))
        data = np.zeros(int(at[-1]), np.uint8)
        for size in np.unique(bits[bits > 0]).tolist():
            own = np.flatnonzero(bits == size)
            place = np.full(len(n), -1)
            place[own] = np.arange(len(own))
            use = place[self.unit] >= 0
            data[at[own][:, None] + np.arange(size >> 3)] = _parities(place[self.unit[use]], self.hashes[use], len(own), size)
        valid = np.packbits(bits > 0, bitorder="little")
        return pa.Array.from_buffers(pa.binary(), len(n), [pa.py_buffer(x) for x in (valid, at.astype(np.int32), data)])


def _parities(unit: np.ndarray, hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    slot = unit * bits + (hashes & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits), axis=1)


def _by_unit(unit: np.ndarray, value: np.ndarray, n_units: int) -> np.ndarray:
    """One sort key for unit and hash; it holds the unit and the hash's top bits (47 or more of them in slices of 128 KB)."""
    bits = np.uint64(max(1, int(n_units).bit_length()))
    return (unit.astype(np.uint64) << (np.uint64(64) - bits)) | (value >> bits)


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of the units ``raw[offsets[i]:offsets[i + 1]]`` in their order, repeats included, each one's unit, and the units' words."""
    n_units, n = len(offsets) - 1, len(raw)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n_units, np.int64)
    if not n:
        return none
    is_word = (raw != 32) & ((raw < 9) | (raw > 13))
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1] | cut[1:n]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | cut[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(s):
        return none
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up, out=total[1:])
    word = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    first = np.searchsorted(s, offsets)  # of each unit's words
    counts = np.diff(first)
    unit = np.repeat(np.arange(n_units), counts)
    left = np.repeat(first[1:], counts) - np.arange(len(s))  # words from here to the unit's end
    padded = np.concatenate([word, np.zeros(K, np.uint64)])
    value = np.zeros(len(s), np.uint64)
    for j in range(K):
        value += np.where(left > j, padded[j : j + len(s)], np.uint64(0)) * _PLACE[j]
    value = mixed(value + np.minimum(left, K).astype(np.uint64) * _PLACE[K])
    head = np.zeros(len(s), bool)
    head[first[:-1][counts > 0]] = True
    use = (left >= K) | head
    return value[use], unit[use], counts


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> Sets:
    """Shingle sets of the units ``raw[offsets[i]:offsets[i + 1]]``."""
    n_units = len(offsets) - 1
    value, unit, counts = shingles(raw, offsets)
    order = np.argsort(_by_unit(unit, value, n_units))
    value, unit = value[order], unit[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (unit[1:] != unit[:-1])
    value, unit = value[new], unit[new]
    return Sets(value, unit, np.searchsorted(unit, np.arange(n_units + 1)), counts)


#: Slots of the table of common shingles (a fixed 4 MB), and how many common shingles it is built from at most.
SLOTS_LOG2, COMMON = 22, 1 << 18


def rarity_table(common: list[tuple[int, int]]) -> bytes:
    """log2 counts of common shingles by the top bits of their hash. It orders shingles only; any table gives exact results."""
    out = np.zeros(1 << SLOTS_LOG2, np.uint8)
    if common:
        h = np.array([x for x, _ in common], np.int64).view(np.uint64)
        level = np.log2(np.array([c for _, c in common], np.float64)).astype(np.uint8) + 1
        np.maximum.at(out, (h >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64), level)
    return out.tobytes()


def rare_prefixes(sets: Sets, table: np.ndarray, similar: int = 80, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(unit, hash, position)`` of each unit's (of those in ``only``) first ``n - ceil(similar * n / 100) + 1`` shingles, rare ones first.

    Two sets with a Jaccard similarity of ``similar`` % or more have one of these in common, as both follow one order.
    """
    level = table[(sets.hashes >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)]
    order = np.argsort(sets.unit * 64 + level, kind="stable")  # hashes are sorted within units
    unit, h = sets.unit[order], sets.hashes[order]
    n = sets.sizes[unit]
    at = np.arange(len(unit)) - sets.starts[unit]
    use = at < n - -(-similar * n // 100) + 1
    if only is not None:
        use &= only[unit]
    return unit[use], h[use], at[use]
