"""Brute-force versions of the operators, row by row in Python."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text: str | None) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def similar(x: frozenset, y: frozenset) -> bool:
    return bool(x) and 100 * len(x & y) >= 80 * len(x | y)


def components(docs: list[tuple]) -> dict:
    """doc_id -> (set size, component) for unique ids."""
    sets = {i: shingles(t) for i, t in docs}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = len(sets[i]), len(sets[j])
            if 100 * min(a, b) >= 80 * max(a, b) and similar(sets[i], sets[j]):
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def kept_lines(docs: list[tuple], short: bool = False) -> dict:
    """doc_id -> kept text, for unique ids."""
    seen: list[frozenset] = []
    out = {}
    by_shingle: dict = {}
    for i, text in sorted(docs):
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            s = shingles(line) if short or len(words(line)) >= 5 else frozenset()
            near = {k for x in s for k in by_shingle.get(x, ())}
            if not any(similar(s, seen[k]) for k in near):
                kept.append(line)
            if s:
                for x in s:
                    by_shingle.setdefault(x, []).append(len(seen))
                seen.append(s)
        out[i] = "\n".join(kept)
    return out


def secret_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    t, out = text or "", []
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    out += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def _luhn(d: str) -> bool:
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def personal_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    t, out = text or "", []
    digits = lambda x: re.sub("[^0-9]", "", x)
    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def digest_of(spans: list[tuple[int, int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


def repeats_cut(docs: list[tuple]) -> dict:
    """doc_id -> (removed, spans, sha256 of what stays), for unique ids."""
    first: dict[bytes, int] = {}
    out = {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 49):
            if first.setdefault(raw[s : s + 50], i) < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
    return out
