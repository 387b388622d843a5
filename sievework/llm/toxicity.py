"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, pairs of neighbours and pairs with one word between are hashed to ``2**BITS`` places; a document has a place
or hasn't.  Each coordinate has its own learning rate and an L1 threshold that leaves most weights at zero, so the
model is a short sorted list that is cheap to broadcast.  Fitting uses at most ``limit`` rows of each class on the
driver; scoring runs over whole texts in Arrow batches.

Null texts count as empty.  A text without known places has the score of the intercept.  Without labelled rows
every text has the same score below a half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import bounds, label_split, mix64, sample_of, text_bytes

BITS = 20
FIT_ROWS = 4_000

_INSIDE = np.zeros(256, bool)
_INSIDE[128:] = True
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15 | 1, np.uint64))


def places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every word, pair and skip pair of a batch of texts, with repeats.

    A word is a run of letters and digits (any character beyond ASCII counts), lower-cased.
    """
    data, offsets = text_bytes(pc.utf8_lower(column))
    inside = _INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(len(data))
    within = at - np.maximum.accumulate(np.where(first, at, 0))
    value = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * _POWERS[within % len(_POWERS)], np.uint64(0))
    word = mix64(np.add.reduceat(value, starts))
    row = np.searchsorted(offsets, starts, "right") - 1
    keys, rows = [word], [row]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        together = row[:-gap] == row[gap:] if len(row) > gap else np.empty(0, bool)
        if together.any():
            keys.append(mix64(word[:-gap] * np.uint64(3) + word[gap:] + np.uint64(salt))[together])
            rows.append(row[:-gap][together])
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class ToxicModel:
    """Places in ascending order with their weights."""

    ids: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, column: pa.Array) -> np.ndarray:
        total = np.full(len(column), self.intercept)
        if len(self.ids) and len(column):
            rows, keys = places(column)
            known = np.zeros(1 << BITS, bool)
            known[self.ids] = True
            hit = known[keys]
            pairs = np.unique((rows[hit] << BITS) | keys[hit])
            np.add.at(total, pairs >> BITS, self.weights[np.searchsorted(self.ids, pairs & ((1 << BITS) - 1))])
        return 1 / (1 + np.exp(-total))


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.01) -> ToxicModel:
    """One pass after another over (places, label); the intercept has no penalty."""
    if not rows:
        return ToxicModel(np.empty(0, np.int64), np.empty(0), -1.0)
    n = 1 << BITS
    z, g2 = np.zeros(n + 1), np.zeros(n + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi, limit = z[at], np.where(at == n, 0.0, l1)
        return np.where(np.abs(zi) > limit, -(zi - np.sign(zi) * limit) / ((beta + np.sqrt(g2[at])) / alpha + l2), 0.0)

    rng = np.random.default_rng(13)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = np.append(rows[i][0], n)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - rows[i][1]
            s = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / alpha
            z[at] += g - s * w
            g2[at] += g * g
    w = weights(np.arange(n + 1))
    ids = np.flatnonzero(w[:n])
    return ToxicModel(ids, w[ids], float(w[n]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, out: int = 0, limit: int = FIT_ROWS) -> ToxicModel:
    """Fit on labelled rows whose ``label_split`` into ``parts`` isn't ``out``, at most ``limit`` of each class."""
    fair = label_split(F.col("doc_id"), parts) != out
    chosen = sample_of(labels.filter(F.col(label) == 1), label, fair, limit, "toxic").union(sample_of(labels.filter(F.col(label) == 0), label, fair, limit, "toxic"))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in bounds(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                rows, keys = places(part.column(1))
                pairs = np.unique((rows << BITS) | keys)
                cut = np.searchsorted(pairs >> BITS, np.arange(len(part) + 1))
                held = (pairs & ((1 << BITS) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(2), pa.array([held[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], ["doc_id", "label", "ids"]
                )

    rows = texts.mapInArrow(work, "doc_id long, label int, ids binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["ids"])))
    return fit([(np.frombuffer(r["ids"], np.int32).astype(np.int64), r["label"]) for r in rows])


def score(docs: DataFrame, model: ToxicModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every row; a column of that name is replaced."""
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    place = kept.index(text)
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in bounds(batch.column(place), 1 << 20):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(part.column(place)), pa.float64())], [*kept, out])

    return source.mapInArrow(work, T.StructType([*source.schema.fields, T.StructField(out, T.DoubleType())]))
