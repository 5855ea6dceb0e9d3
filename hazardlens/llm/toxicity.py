"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what sets toxic text apart. Each window of a
text is compressed with either: the bytes that the toxic dictionary saves say how toxic the window is. A text's score
comes from shares of windows beyond thresholds of savings, by a logistic model calibrated on labelled texts that the
dictionaries haven't seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.arrowtext import tidy
from hazardlens.llm.exprs import spare

#: Labelled rows of each class that the model is fitted on at most, and bytes of text of each class.
ROWS, TEXT_BYTES = {1: 1_500, 0: 3_000}, {1: 16 << 20, 0: 24 << 20}
WINDOW, STEP, LEVEL = 40, 24, 6
ORDINARY, TOXIC = 8_192, 2_048  # bytes of dictionary content
#: Savings in bytes from which a window counts; one feature each.
SAVED = (2, 3, 4, 5, 6)
ACCEPTED = 0.7
_BREAK = re.compile(rb"[\x20\x09-\x0D.,;:!?\"'()|#*$%&-]+")


@dataclass(frozen=True)
class Model:
    """Contents of both dictionaries; weights of the features, intercept first."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _stems(text: bytes) -> dict[bytes, list[bytes]]:
    out: dict[bytes, list[bytes]] = {}
    for word in _BREAK.split(text):
        for k in (4, 5, 6):
            if len(word) >= k:
                out.setdefault(word[:k], []).append(word)
    return out


def telling_words(toxic: list[bytes], ordinary: list[bytes], most: int = 96) -> list[bytes]:
    """Words of toxic texts whose stem occurs in them beyond chance (Chernoff bound over all stems) and 25 times as often."""
    a, b, words = Counter(), Counter(), {}
    for t in toxic:
        found = _stems(t)
        a.update(found.keys())
        for stem, own in found.items():
            words.setdefault(stem, []).extend(own[:2])
    for t in ordinary:
        b.update(_stems(t).keys())
    na, nb = len(toxic), len(ordinary)
    p, need = na / max(na + nb, 1), math.log(max(len(a), 1) / 1e-3)

    def evidence(s: bytes) -> float:
        n = a[s] + b[s]
        q = a[s] / n
        if q <= p or a[s] * (nb + 1) < 25 * (b[s] + 0.5) * na:
            return 0
        return n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0))

    best = sorted(((e, s) for s in a if (e := evidence(s)) > need), reverse=True)[:most]
    return [w for _, s in best for w in words[s][:30]]


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on ``samples``; with too few for training, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STEP), STEP)] if text else []


class Scorer:
    def __init__(self, model: Model):
        def compressor(content: bytes):
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=5, write_content_size=False, write_checksum=False, write_dict_id=False)
            held = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress

        n = len(model.toxic)  # both have the same size and end alike, so that only the toxic part tells them apart
        self.toxic = compressor(model.toxic + model.ordinary[n:])
        self.ordinary = compressor(model.ordinary)
        self.weights = np.array(model.weights)

    def features(self, text: bytes) -> np.ndarray:
        a, b = self.ordinary, self.toxic
        saved = np.array([len(a(w)) - len(b(w)) for w in windows(text)] or [0])
        n = len(saved)
        counts = [(saved >= s).sum() for s in SAVED]
        top = np.sort(saved)[-3:]
        return np.array([1.0, *[math.sqrt(c / n) for c in counts], *[math.log1p(c) for c in counts[1:4]], float(saved.max()), float(top.sum()) / 3, math.log1p(n), float(saved.mean())])

    def score(self, text: bytes) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.features(text) @ self.weights))))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps, both classes weighing alike; weights for the unscaled features."""
    mean, scale = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-9
    z = np.hstack([x[:, :1], (x[:, 1:] - mean) / scale])
    own = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w, keep = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * (z.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (own * p * (1 - p))) @ z + keep, z.T @ (own * (y - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[0] - (w[1:] / scale) @ mean, w[1:] / scale)


def fit(toxic: list[bytes], ordinary: list[bytes], false_share: float = 0.01) -> Model:
    """Dictionaries from two of three texts; weights, and the level that is ACCEPTED, from the third.

    The intercept is shifted so that about ``false_share`` of the ordinary calibration texts reach ACCEPTED. Without
    texts of both classes everything scores 0.
    """
    if not toxic or not ordinary:
        return Model(b"", b"", (-30.0, *[0.0] * (len(SAVED) + 7)))
    part = lambda texts, last: [t for i, t in enumerate(texts) if (i % 3 == 2) == last] or texts
    rng = np.random.default_rng(7)
    plain = [w for t in part(ordinary, False) for w in windows(t)]
    plain = [plain[i] for i in rng.permutation(len(plain))[:12_000]]
    words = telling_words(part(toxic, False), part(ordinary, False))
    words = [b" " + words[i] for i in rng.permutation(len(words))]
    samples = [b"".join(words[i : i + 8]) for i in range(0, len(words), 8)]
    content = _trained(samples, TOXIC) if samples else b""
    model = Model(_trained(plain, ORDINARY), content, ())
    scorer = Scorer(model)
    x = np.array([scorer.features(t) for t in [*part(toxic, True), *part(ordinary, True)]])
    y = np.array([1] * len(part(toxic, True)) + [0] * len(part(ordinary, True)))
    w = _logistic(x, y)
    level = math.log(ACCEPTED / (1 - ACCEPTED))
    w[0] += level - max(np.quantile(x[y == 0] @ w, 1 - false_share) + 1e-6, 0.0)
    return Model(model.ordinary, model.toxic, tuple(float(v) for v in w))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most ROWS labelled rows of each class (those with the smallest hash of their id), none held out.

    Of these, texts beyond TEXT_BYTES of a class in all are passed over, so that the fit's memory is bounded.

    Labels for ids without a document, null labels and null ids are not used.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ROWS.items()]
    ids = ids[0].unionByName(ids[1]).select(F.col("doc_id").alias("_id"), "toxic")
    one = F.struct(F.length(F.coalesce("text", F.lit(""))).alias("n"), "text")
    rows = docs.select("doc_id", F.col("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).filter(F.col("text").isNotNull())
    rows = rows.groupBy("_id", "toxic").agg(F.min(one).alias("t")).select("toxic", F.xxhash64("_id").alias("h"), "_id", F.col("t.n").alias("n"), "t.text")
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    held = {0: 0, 1: 0}
    for r in rows.orderBy("h", "_id").toLocalIterator():
        raw = r["text"].encode()
        if held[r["toxic"]] + len(raw) <= TEXT_BYTES[r["toxic"]]:
            held[r["toxic"]] += len(raw)
            texts[r["toxic"]].append(raw)
    return fit(texts[1], texts[0])


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs``, all columns and rows, plus a column ``name`` from 0 to 1; null text scores as empty. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    at = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            scores = [scorer.score((t.as_py() or "").encode()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], schema.names)

    return docs.mapInArrow(tidy(of), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``.

    ``predicted`` is 1 from a score of 0.7 on. Null text counts as empty and scores like it; repeated rows score alike;
    an empty table gives an empty one; null ids are scored and are not held out. Scores depend on the text alone.
    """
    out = scored(docs.select("doc_id", "text"), fitted(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def ordinary_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't predicted toxic."""
    (name,) = spare(docs, "score")
    return scored(docs, fitted(docs, labels), name).filter(F.col(name) < ACCEPTED).select(*docs.columns)
