"""Exact top-k search by inner product without random access.

Candidates lie in blocks; in each, every component is a list sorted by value, read from the end that the sign of a
query's component prefers.  After reading to a depth, a component that has been seen counts as it is, any other
lies between the last value read (upper bound) and the list's far end (lower bound).  Both bounds of all
candidates of a block for a set of queries are products of clipped matrices.  A candidate whose upper bound is
below the k-th lower bound (or the k-th score among the most promising, which are resolved at once) can't qualify;
when few are left, their final scores are resolved, otherwise reading goes on, at last to the end.

Blocks of queries meet blocks of candidates, a task each, so memory is bounded; each pair gives k rows a query.
Vectors that are null, empty, or hold null or non-finite components take no part.  A shorter vector's missing
components count as 0.  Equal rows count once; rows that share the query's id are its own and no candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import stored
from sievework.llm.vectors import matrix, ranked, usable, widest

#: Depths, as parts of a list, at which bounds are looked at; the last reads everything.
DEPTHS = (0.5, 1.0)


def top_of_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of the ``k`` best candidates of a block for each query; whole numbers in float64 or float32."""
    n = len(ids)
    down = -np.sort(-x, axis=0)  # the sorted lists, best first for positive components, last first for negative ones
    far_low, far_high = down[-1], down[0]
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo = np.arange(len(qids))
    for depth in DEPTHS:
        if not len(todo):
            break
        p, m = plus[todo], minus[todo]
        read = min(n, max(1, int(np.ceil(depth * n))))
        if read >= n:
            upper = lower = p @ x.T + m @ x.T
        else:
            high, low = down[read - 1], down[n - read]
            upper = p @ np.maximum(x, high).T + m @ np.minimum(x, low).T
            lower = p @ np.where(x >= high, x, far_low).T + m @ np.where(x <= low, x, far_high).T
        own = qids[todo][:, None] == ids[None]
        upper[own] = -np.inf
        if lower is not upper:
            lower[own] = -np.inf
        if n > k:
            limit = np.partition(lower, n - k, axis=1)[:, n - k]
            if read < n:
                likely = np.argpartition(upper, n - k, axis=1)[:, n - k :]
                exact = np.einsum("ijk,ik->ij", x[likely], q[todo])
                exact[np.take_along_axis(own, likely, 1)] = -np.inf
                limit = np.maximum(limit, exact.min(1))
        else:
            limit = np.full(len(todo), -np.inf)
        open_ = (upper >= limit[:, None]) & ~own
        few = open_.sum(1) <= (n if read >= n else n // 32)
        for i in np.flatnonzero(few):
            at = np.flatnonzero(open_[i])
            score = upper[i, at] if read >= n else x[at] @ q[todo[i]]
            best = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(best), qids[todo[i]]), ids[at[best]], score[best]))
        todo = todo[~few]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def whole_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of a block for every query by all its products, in integers."""
    out = []
    for qid, row in zip(qids, q @ x.T):
        at = np.flatnonzero(ids != qid)
        best = at[np.lexsort((ids[at], -row[at]))[:k]]
        out.append((np.full(len(best), qid), ids[best], row[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "ints", block: int = 8192, queries_block: int = 2048, chunk: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest inner products of whole-number vectors.

    ``is_query`` marks the rows that are queries too.  Bounds are exact while products stay below 2**53; blocks beyond
    are scored whole in 64-bit integers, and vectors whose scores might not fit these end the query with an error.
    """
    clean = stored(vectors.filter(F.col(id_column).isNotNull() & usable(F.col(vector))).select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).dropDuplicates(["vec_id", "v"]), "topk-vectors")
    sizes = clean.agg(F.count("*").alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    blocks, query_blocks = -(-sizes["n"] // block) or 1, -(-sizes["q"] // queries_block) or 1
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = clean.filter("q").select(part(query_blocks, 1).alias("qb"), every(blocks).alias("cb"), "vec_id", "v")
    rows = clean.select(every(query_blocks).alias("qb"), part(blocks, 2).alias("cb"), "vec_id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        width = max(widest(left["v"]), widest(right["v"]))
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q, x = matrix(left["v"], width, np.float64), matrix(right["v"], width, np.float64)
        largest = width * np.abs(q).max(initial=0) * np.abs(x).max(initial=0)
        if largest < 2**24:
            q, x = q.astype(np.float32), x.astype(np.float32)
        if largest >= 2**63:
            raise ValueError("scores of these vectors don't fit a long")
        block_of = top_of_block
        if largest >= 2**53:  # beyond what doubles hold exactly
            q, x, block_of = q.astype(np.int64), x.astype(np.int64), whole_block
        qids, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        found = [block_of(ids, x, qids[i : i + chunk], q[i : i + chunk], k) for i in range(0, len(qids), chunk)]
        a, b, c = (np.concatenate(z) for z in zip(*found))
        return pa.table({"query_id": a.astype(np.int64), "vec_id": b.astype(np.int64), "score": c if c.dtype == np.int64 else np.rint(c).astype(np.int64)})

    met = queries.groupBy("qb", "cb").cogroup(rows.groupBy("qb", "cb")).applyInArrow(meet, "query_id long, vec_id long, score long")
    return ranked(met, k, F.desc("score")).select("query_id", "rank", "vec_id", "score")


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
