"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by splitting the largest cluster in two until all are small, so lists are
balanced.  Every vector is written to the list of its nearest centroid and, if it lies near a border, to further
ones: those within a distance ratio that aren't closer to a chosen centroid than to the vector.  A query walks a
graph of the centroids in memory from near to nearer, and reads the lists within a distance ratio of the nearest
centroid.  That ratio is set on the sample, where the true neighbours are known.  The centroids are bounded by the
sample and are broadcast; lists are tables, and a long list (say of equal vectors) is cut into chunks.

Vectors that are null, empty, zero, or hold null or non-finite components take no part.  Rows that share an id and
a vector count once; different vectors of one id are candidates each, and rows with the query's id are its own.  Ties go
to the smaller id.  If candidates are too few for one list, all are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import stored, unit_hash
from sievework.llm.vectors import matrix, ranked, usable, widest

#: Vectors of the sample at most, and the usual number of vectors a list stands for in it.
FIT_ROWS, LIST_ROWS = 8_192, 64
#: Rows of a chunk of a long list.
CHUNK_ROWS = 4_096


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows; good for choosing, not for scores."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def split_balanced(x: np.ndarray, size: int, seed: int = 5) -> np.ndarray:
    """Centroids of clusters of at most ``size`` rows; rows that are all equal stay together."""
    rng, todo, done = np.random.default_rng(seed), [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size or (x[rows] == x[rows[0]]).all():
            done.append(x[rows].mean(0))
            continue
        axis = x[rng.choice(rows, 2, replace=False)]
        along = axis[0] - axis[1] if (axis[0] != axis[1]).any() else rng.normal(size=x.shape[1])
        for _ in range(6):  # two means, cut at the middle row so that both halves are alike
            at = x[rows] @ along
            low = at <= np.median(at)
            if low.all() or not low.any():
                low = at < at.max() if (at < at.max()).any() else np.arange(len(rows)) % 2 == 0
            along = x[rows[~low]].mean(0) - x[rows[low]].mean(0)
            if not along.any():
                break
        todo += [rows[low], rows[~low]]
    return np.unique(np.array(done), axis=0)


@dataclass
class Index:
    """Centroids, their graph, and the ratios for writing (``border``) and reading (``reach``) lists."""

    centroids: np.ndarray
    links: list[np.ndarray]
    border: float
    reach: float
    copies: int

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists each row is written to, nearest first."""
        d = np.sqrt(distances(x, self.centroids))
        near = np.argsort(d, 1, kind="stable")[:, : self.copies * 2]
        between = np.sqrt(distances(self.centroids, self.centroids))
        out = []
        for i, row in enumerate(near):
            chosen = [row[0]]
            for c in row[1:]:
                if len(chosen) == self.copies or d[i, c] > self.border * d[i, row[0]]:
                    break
                if all(between[c, o] > d[i, c] for o in chosen):
                    chosen.append(c)
            out.append(np.array(chosen))
        return out

    def walk(self, q: np.ndarray) -> list[int]:
        """The lists to read for a query, by a best-first walk over the graph."""
        d = np.sqrt(((self.centroids[0] - q) ** 2).sum())
        best, seen, heap, found = d, {0}, [(d, 0)], []
        settled = False
        while heap:
            d, c = heapq.heappop(heap)
            if settled and d > self.reach * best:
                break
            found.append((d, c))
            new = [o for o in self.links[c].tolist() if o not in seen]
            seen.update(new)
            if new:
                for o, e in zip(new, np.sqrt(((self.centroids[new] - q) ** 2).sum(1)).tolist()):
                    heapq.heappush(heap, (e, o))
                    best = min(best, e)
            settled = not heap or heap[0][0] > best or len(found) > len(self.centroids) // 4
        return [c for d, c in found if d <= self.reach * best] or [min(found)[1]]


def fit(sample: np.ndarray, k: int = 10, recall: float = 0.97, border: float = 1.1, copies: int = 4, degree: int = 16, seed: int = 3) -> Index:
    """Centroids of the sample, their graph, and the smallest reach that finds ``recall`` of the sample's own neighbours."""
    c = split_balanced(sample, LIST_ROWS) if len(sample) else np.zeros((1, 1))
    near = np.argsort(distances(c, c), 1, kind="stable")[:, 1 : degree + 1]
    links = [set(row.tolist()) for row in near]
    for i in range(len(c)):  # a ring keeps the graph in one piece
        for j in [*links[i], (i + 1) % len(c)]:
            links[i].add(j)
            links[j].add(i)
    index = Index(c, [np.array(sorted(s - {i})) for i, s in enumerate(links)], border, 1.0, copies)
    if len(sample) <= k + 1:
        index.reach = 1e9
        return index
    rng = np.random.default_rng(seed)
    tries = rng.choice(len(sample), min(len(sample), 200), replace=False)
    d = distances(sample[tries], sample)
    d[np.arange(len(tries)), tries] = np.inf
    true = np.argpartition(d, k, 1)[:, :k]
    written = index.lists_of(sample)
    to = np.sqrt(distances(sample[tries], c))
    ratio = to / np.maximum(to.min(1, keepdims=True), 1e-12)
    needed = np.sort([min(ratio[i, lists] .min() for lists in [written[t]]) for i in range(len(tries)) for t in true[i]])
    index.reach = float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1e-9
    return index


def build(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", limit: int = FIT_ROWS, **options) -> tuple[Index, DataFrame, DataFrame]:
    """The index, its lists (``list, vec_id, v``, stored) and the clean vectors (``vec_id, v``, stored)."""
    d = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    clean = stored(d.filter(F.col("vec_id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"]), "ann-vectors")
    rows = clean.orderBy(unit_hash(F.lit("ann"), F.col("vec_id")), "vec_id").limit(limit).toArrow()
    width = widest(rows["v"])
    index = fit(np.unique(matrix(rows["v"], width, np.float64), axis=0) if width else np.zeros((0, 1)), **options)
    shared = clean.sparkSession.sparkContext.broadcast(index)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                lists = shared.value.lists_of(fitted(part.column(1), shared.value))
                at = np.repeat(np.arange(len(part)), [len(x) for x in lists])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at))], ["list", "vec_id", "v"])

    return index, stored(clean.mapInArrow(write, "list int, vec_id long, v array<double>"), "ann-lists"), clean


def fitted(column: pa.Array, index: Index) -> np.ndarray:
    """Vectors at the width of the centroids, for choosing lists."""
    width = index.centroids.shape[1]
    return matrix(column, max(width, widest(column)), np.float64)[:, :width]


def search(index: Index, lists: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for ``queries`` (``vec_id, v``)."""
    shared = lists.sparkSession.sparkContext.broadcast(index)
    chunks = lists.groupBy("list").count().select("list", F.ceil(F.col("count") / CHUNK_ROWS).cast("int").alias("chunks"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [shared.value.walk(q) for q in fitted(batch.column(1), shared.value)]
            at = pa.array(np.repeat(np.arange(len(batch)), [len(x) for x in read]))
            flat = np.array([c for x in read for c in x], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(flat)], ["query_id", "v", "list"])

    asked = queries.select("vec_id", "v").mapInArrow(choose, "query_id long, v array<double>, list int").join(chunks, "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "query_id", "v")
    rows = lists.join(chunks, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), "vec_id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        width = max(widest(left["v"]), widest(right["v"]))
        q, x = matrix(left["v"], width, np.float64), matrix(right["v"], width, np.float64)
        qids, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        out = []
        for i in range(0, len(q), 256):
            d = distances(q[i : i + 256], x)
            d[qids[i : i + 256, None] == ids[None]] = np.inf
            limit = np.partition(d, k - 1, 1)[:, k - 1] if len(ids) > k else np.full(len(d), np.inf)
            for j, row in enumerate(d):
                at = np.flatnonzero((row <= limit[j] + 1e-9 * (1 + np.minimum(limit[j], 1e300))) & np.isfinite(row))
                exact = np.sqrt(((x[at] - q[i + j]) ** 2).sum(1))
                best = np.lexsort((ids[at], exact))[:k]
                out.append((np.full(len(best), qids[i + j]), ids[at[best]], exact[best]))
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    met = asked.groupBy("list", "chunk").cogroup(rows.groupBy("list", "chunk")).applyInArrow(meet, "query_id long, vec_id long, score double")
    return ranked(met.dropDuplicates(["query_id", "vec_id", "score"]), k, F.col("score").asc()).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, **options) -> DataFrame:
    """Build the index over all ``vectors`` and search it with those that ``is_query`` (on ``vec_id``) marks."""
    index, lists, clean = build(vectors, k=k, **options)
    return search(index, lists, clean.filter(is_query), k)
