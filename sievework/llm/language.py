"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams of one to three characters are hashed.  The weights are trained by follow the regularised
leader with an elastic net (L1 keeps the table sparse, L2 keeps it small), then one temperature is fitted on rows
that the weights haven't seen.  Fitting uses at most ``limit`` rows on the driver, shared out over the languages, so
that a rare one is learned beside a frequent one; document frequencies are counted over all training documents.
Scoring runs over whole texts in Arrow batches, each n-gram one look-up in a table of fixed size.

A text that is null or has no letter gets ``und`` with score 0.  Without training rows every text gets ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievework.llm.common import bounds, label_split, mix64, unit_hash

BITS = 16
FIT_ROWS = 4_000
LETTER = re.compile(r"[^\W\d_]")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the texts end to end, and for each text where its n-grams start.

    A text is lower-cased and wrapped in spaces, so that its n-grams don't depend on its neighbours.
    """
    padded = [f" {t.lower()}  " for t in texts]
    sizes = np.array([len(p) for p in padded], np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    own = np.ones(len(codes), bool)
    own[ends - 1] = own[ends - 2] = False
    keys = np.empty((int(own.sum()), 3), np.uint64)
    first = np.flatnonzero(own)
    one, two, three = codes[first], codes[first + 1], codes[first + 2]
    keys[:, 0] = one
    keys[:, 1] = (one << np.uint64(21)) | two | np.uint64(1 << 62)
    keys[:, 2] = (one << np.uint64(42)) | (two << np.uint64(21)) | three | np.uint64(1 << 63)
    starts = np.cumsum(np.concatenate([[0], sizes[:-1] - 2]))
    return (mix64(keys) >> np.uint64(64 - BITS)).astype(np.int32), starts


def counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct hashed n-grams and their shares."""
    keys, starts = grams(texts)
    out = []
    for a, b in zip(starts, [*starts[1:], len(keys)]):
        ids, n = np.unique(keys[a:b], return_counts=True)
        out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # hashed n-gram x language: idf times weight
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(self.languages)))
        keys, starts = grams(texts)
        sizes = np.diff(np.append(starts, len(keys)))
        total = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            column = self.table[:, i]
            total[:, i] = np.add.reduceat(column[keys[:, 0]] + column[keys[:, 1]] + column[keys[:, 2]], starts)
        return total / (3 * np.maximum(sizes, 1))[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        said = [bool(t) and bool(LETTER.search(t)) for t in texts]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits([t or "" for t in texts]) / self.temperature)
        best = p.argmax(1) if len(texts) else np.zeros(0, int)
        return [self.languages[b] if s else "und" for b, s in zip(best, said)], np.where(said, p.max(1), 0.0) if len(texts) else np.zeros(0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], df: np.ndarray | None = None, documents: int = 0, epochs: int = 3, rate: float = 0.3, l1: float = 0.02, l2: float = 0.05, scale: float = 30.0) -> LanguageModel:
    """FTRL over the rows' (ids, shares, language); every fifth row of a language is kept for the temperature.

    ``df`` counts the ``documents`` that have an n-gram; by default they are those learned from.
    """
    languages = sorted({x[2] for x in rows})
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    learn, hold, met = [], [], dict.fromkeys(languages, 0)
    for r in rows:
        met[r[2]] += 1
        (learn if met[r[2]] % 5 else hold).append(r)
    if df is None:
        df, documents = np.zeros(1 << BITS), len(learn)
        for ids, _, _ in learn:
            df[ids] += 1
    idf = np.log((1 + documents) / (1 + df)) + 1
    n, k = 1 << BITS, len(languages)
    z, g2 = np.zeros((n + 1, k)), np.zeros((n + 1, k))

    def weights(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((1 + np.sqrt(g2[ids])) / rate + l2), 0.0)

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            ids, share, language = learn[i]
            at, x = np.append(ids, n), np.append(share * idf[ids] * scale, 1.0)
            w = weights(at)
            off = softmax((x @ w)[None])[0]
            off[languages.index(language)] -= 1
            g = x[:, None] * off
            s = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / rate
            z[at] += g - s * w
            g2[at] += g * g
    w = weights(np.arange(n + 1))
    model = LanguageModel(languages, (w[:n] * idf[:, None] * scale).astype(np.float32), w[n], 1.0)
    if hold:
        raw = np.stack([share @ model.table[ids] + model.bias for ids, share, _ in hold])
        truth = np.array([languages.index(x[2]) for x in hold])
        loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
    return model


def shared_out(sizes: dict[str, int], limit: int) -> dict[str, int]:
    """Rows for each language, ``limit`` in all: an equal part each, what small ones leave goes to the others."""
    quotas, left = {}, limit
    for i, (label, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        quotas[label] = min(n, -(-left // (len(sizes) - i)))
        left -= quotas[label]
    return quotas


def sample_by_language(known: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` of ``doc_id, label`` in the order of a hash, shared out over the languages.

    Only rows whose hash lies in the first part that holds about twice a language's rows are ranked.
    """
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(limit).collect()}
    parts = [(k, q, min(1.0, (2 * q + 50) / sizes[k])) for k, q in shared_out(sizes, limit).items()]
    quotas = known.sparkSession.createDataFrame(parts, "label string, quota long, part double")
    hashed = known.withColumn("at", unit_hash(F.lit("language"), F.col("doc_id")))
    near = hashed.join(F.broadcast(quotas), "label").filter(F.col("at") <= F.col("part") * float(2**60))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("at", "doc_id"))).filter("rank <= quota").select("doc_id", "label")


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many rows of ``text`` have each hashed n-gram, and how many rows there are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((1 << BITS) + 1, np.int64), np.zeros(1 << BITS, bool)
        for batch in batches:
            for a, b in bounds(batch.column(0), 1 << 20):
                keys, starts = grams(batch.column(0).slice(a, b - a).to_pylist())
                for i, j in zip(starts, [*starts[1:], len(keys)]):
                    seen[keys[i:j].ravel()] = True
                    ids = np.flatnonzero(seen)
                    total[ids] += 1
                    seen[ids] = False
                total[-1] += b - a
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids])], ["gram", "n"])

    df = np.zeros((1 << BITS) + 1, np.int64)
    for gram, n in docs.select("text").mapInArrow(work, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():
        df[gram] = n
    return df[:-1], int(df[-1])


def train(docs: DataFrame, parts: int = 5, out: int = 0, limit: int = FIT_ROWS) -> LanguageModel:
    """Fit on rows with a language whose ``label_split`` into ``parts`` isn't ``out``."""
    eligible = F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != "und") & (label_split(F.col("doc_id"), parts) != out)
    own = docs.filter(eligible)
    chosen = sample_by_language(own.groupBy("doc_id").agg(F.max("lang").alias("label")), limit)
    texts = own.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in bounds(batch.column(1), 4 << 20):
                part = batch.slice(a, b - a)
                found = counts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(2), pa.array([x.astype(np.int32).tobytes() for x, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())],
                    ["doc_id", "label", "ids", "shares"],
                )

    rows = texts.mapInArrow(work, "doc_id long, label string, ids binary, shares binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"], bytes(r["ids"])))
    df, documents = document_frequencies(own)
    return fit([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["shares"], np.float32), r["label"]) for r in rows], df, documents)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    place = kept.index(text)
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in bounds(batch.column(place), 1 << 20):
                part = batch.slice(a, b - a)
                said, p = shared.value.predict(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string()), pa.array(p, pa.float64())], [*kept, "lang_pred", "score"])

    return source.mapInArrow(work, T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
