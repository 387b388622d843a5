"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours.

Equal vectors are one node from the start.  Lists of ``LIST`` neighbours begin with blocks of nodes that lie next to
each other when sorted by codes of random hyperplanes.  In each round every node brings its neighbours together, both
those in its list and those whose list it is in; pairs of which one is new are compared, and what is nearer than the
end of a list enters it.  Rounds end when hardly any new entry reaches the threshold.  Entries that may reach it are
then computed on the vectors in double precision, and those that do are the links.

A list that is full of links is saturated, so more may exist: it is enlarged to its whole component of the links.  In
such a component the vectors within half the threshold's angle of its mean are linked to each other, by the triangle
inequality of angles, and are only counted; each of the others is compared with all members, in blocks, and only counts
leave a task.  So a group of near copies costs its size, and pairs within it are never rows.

The links of a bounded sample of nodes are counted by brute force.  If too few of them were found, more tables of codes
are added and the rounds go on.  ``Result.recall`` has the last figure.

Hot groups: equal codes are split by node; a node with many neighbours brings them together in chunks; lists break ties
by a hash, so that near copies don't all name the same node; top lists are cut in each task before the shuffle.
What reaches the driver are counts, the sample (``AUDIT`` vectors) and the figures of the audit.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing.  Shorter vectors count as
filled with zeros.  Rows with one id keep their own vectors.  A row without id counts as a link of others; a component
is named after the smallest id in it, null if it has none.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import mix64, stored, unit_hash
from sievework.llm.components import components
from sievework.llm.vectors import matrix, usable

#: Neighbours in a list, of these kept from one block, rows of a block, tables of codes at first, hyperplanes of a code.
LIST, KEEP, BLOCK, TABLES, PLANES = 8, 4, 256, 8, 62
#: Nodes that audit the graph, and the mean share of their links that has to be found.
AUDIT, RECALL = 1024, 0.99
#: Neighbours of one node compared together at most (about), and rows compared by one task.
TOGETHER, TASK_ROWS = 48, 65_536
#: Similarities of rounded vectors are off by less than this.
MARGIN = 0.02
#: Rows of a block of members and of a block of those compared with them.
MEMBERS, LOOSE = 16_384, 8_192


def rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from -127 to 127 for each component, and what they are to be multiplied with."""
    scale = np.maximum(np.abs(unit).max(1), 1e-300) / 127
    return np.rint(unit / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    data = np.ascontiguousarray(rows)
    width = data.dtype.itemsize * data.shape[1]
    offsets = np.arange(len(data) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _rows(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if len(column) else np.empty((0, 1), kind)


def _nodes(clean: DataFrame) -> tuple[DataFrame, int]:
    """``node, id, copies, v, unit, near`` of every distinct vector, stored, and their number."""
    classes = clean.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    plain = stored(classes.sortWithinPartitions("id", "v").withColumn("node", F.monotonically_increasing_id()), "neardup-classes")
    size = plain.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    width = size["width"] or 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                unit = units(matrix(part.column(3), width, np.float64))
                whole, scale = rounded(unit)
                near = np.concatenate([scale.view(np.int8).reshape(-1, 4), whole], 1)
                yield pa.RecordBatch.from_arrays([*part.columns, _binary(unit), _binary(near)], ["node", "id", "copies", "v", "unit", "near"])

    made = plain.select("node", "id", "copies", "v").mapInArrow(work, "node long, id long, copies long, v array<double>, unit binary, near binary")
    return stored(made, "neardup-nodes"), size["n"]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rounded vectors as floats."""
    raw = _rows(column, np.int8)
    return raw[:, 4:].astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _beginning(nodes: DataFrame, threshold: float, first: int, tables: int) -> DataFrame:
    """``u, v, s, star`` of near nodes in blocks of like codes, stored.  A star is a link that holds a crowd together."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(PLANES, dtype=np.int64)[::-1]
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                x = _matrix(part.column(1))
                for t in range(first, first + tables):
                    planes = np.random.default_rng([t, 77]).normal(size=(x.shape[1], PLANES)).astype(np.float32)
                    codes = ((x @ planes) > 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(codes), part.column(0), part.column(1)], ["t", "code", "node", "near"])

    laid = nodes.select("node", "near").mapInArrow(code, "t int, code long, node long, near binary")
    laid = laid.repartitionByRange("t", "code", F.xxhash64("node", "t")).sortWithinPartitions("t", "code", F.xxhash64("node", "t"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(t, prepend=-1)).tolist() + [len(t)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                for i in range(a, b, BLOCK):
                    part = batch.slice(i, min(BLOCK, b - i))
                    if len(part) < 2:
                        continue
                    node, x = part.column(2).to_numpy(), _matrix(part.column(3))
                    s = x @ x.T
                    np.fill_diagonal(s, -2)
                    keep = min(KEEP, len(s) - 1)
                    best = np.argpartition(-s, keep - 1, 1)[:, :keep]
                    like = s >= threshold - MARGIN
                    crowd = np.flatnonzero(like.sum(1) > keep)
                    lead = like[crowd].argmax(1)
                    u = np.concatenate([np.repeat(node, keep), node[crowd]])
                    v = np.concatenate([node[best.ravel()], node[lead]])
                    of = np.concatenate([np.take_along_axis(s, best, 1).ravel(), s[crowd, lead]])
                    star = np.arange(len(u)) >= len(node) * keep
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(of.astype(np.float32)), pa.array(star)], ["u", "v", "s", "star"])

    return stored(laid.mapInArrow(compare, "u long, v long, s float, star boolean"), "neardup-begin")


def _merged(found: DataFrame) -> DataFrame:
    """The ``LIST`` nearest of each node, ``u, v, s, fresh``, stored."""
    once = found.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    tie = F.xxhash64(F.least("u", "v"), F.greatest("u", "v"))
    order = Window.partitionBy("u").orderBy(F.col("s").desc(), tie, "v")
    return stored(once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LIST).drop("rank"), "neardup-lists")


def _met(table: pa.Table) -> pa.Table:
    """Compare the members of each group: pairs with a fresh one that are nearer than the end of a list."""
    table = table.combine_chunks()
    group, node, bound, fresh = (table[c].to_numpy(zero_copy_only=False) for c in ("group", "m", "bound", "fresh"))
    order = np.lexsort((node, group))
    group, node, bound, fresh, x = group[order], node[order], bound[order], fresh[order], _matrix(table["near"])[order]
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if len(group) else 0))
    sizes = np.diff(np.append(starts, len(group)))
    x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    by = np.argsort(sizes, kind="stable")
    us, vs, ss = [], [], []
    at = 0
    while at < len(by):
        most, to = 0, at
        while to < len(by) and (to == at or (to - at + 1) * max(most, sizes[by[to]]) ** 2 <= 1 << 21):
            most = max(most, sizes[by[to]])
            to += 1
        chosen = by[at:to]
        at = to
        place = starts[chosen][:, None] + np.arange(most)[None]
        there = np.arange(most)[None] < sizes[chosen][:, None]
        member = np.where(there, place, len(group))
        s = np.matmul(x[member], x[member].transpose(0, 2, 1))
        new = np.append(fresh, False)[member]
        limit = np.append(bound, np.inf).astype(np.float32)[member]
        pairs = there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]) & (s > limit[:, :, None])
        pairs &= ~np.eye(most, dtype=bool)[None]
        g, i, j = np.nonzero(pairs)
        us.append(node[member[g, i]])
        vs.append(node[member[g, j]])
        ss.append(s[g, i, j])
    u, v, s = (np.concatenate(z) if z else np.empty(0, k) for z, k in ((us, np.int64), (vs, np.int64), (ss, np.float32)))
    differ = u != v
    u, v, s = u[differ], v[differ], s[differ]
    order = np.lexsort((v, u))
    u, v, s = u[order], v[order], s[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, s = u[first], v[first], s[first]
    order = np.lexsort((mix64(np.minimum(u, v).astype(np.uint64) * np.uint64(3) + np.maximum(u, v).astype(np.uint64)), -s, u))
    u, v, s = u[order], v[order], s[order]
    heads = np.flatnonzero(np.diff(u, prepend=-1))
    rank = np.arange(len(u)) - np.repeat(heads, np.diff(np.append(heads, len(u))))
    keep = rank < LIST
    return pa.table({"u": u[keep].astype(np.int64), "v": v[keep].astype(np.int64), "s": s[keep].astype(np.float32)})


def _round(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """What the neighbours of each node find in each other, ``u, v, s``."""
    both = lists.select(F.col("u").alias("c"), F.col("v").alias("m"), "fresh").unionAll(lists.select(F.col("v").alias("c"), F.col("u").alias("m"), "fresh"))
    pairs = stored(both.groupBy("c", "m").agg(F.max("fresh").alias("fresh")), "neardup-pairs")
    centres = pairs.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("any")).filter("any AND n > 1")
    chunk = F.pmod(F.xxhash64("m", "c"), F.ceil(F.col("n") / TOGETHER))
    visits = pairs.join(centres, "c").select(F.xxhash64("c", chunk).alias("group"), "m", "fresh")
    # A saturated list needs no better entries; an open one takes all.
    full = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("least"))
    end = F.when(F.col("n") < LIST, -2.0).when(F.col("least") >= threshold + MARGIN, 2.0).otherwise(F.col("least")).cast("float")
    known = nodes.select(F.col("node").alias("m"), "near").join(full.select(F.col("u").alias("m"), end.alias("bound")), "m")
    total = pairs.count()
    tasks = max(1, -(-total // TASK_ROWS))
    met = visits.join(known, "m").withColumn("task", F.pmod("group", F.lit(max(tasks, 16))))
    return met.select("task", "group", "m", "bound", "fresh", "near").groupBy("task").applyInArrow(_met, "u long, v long, s float")


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those of ``a, b`` whose vectors reach the threshold in double precision, stored."""
    held = nodes.select("node", "unit")
    met = pairs.join(held.toDF("a", "p"), "a").join(held.toDF("b", "q"), "b").select("a", "b", "p", "q")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                cosine = (_rows(part.column(2), np.float64) * _rows(part.column(3), np.float64)).sum(1)
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(pa.array(cosine >= threshold))

    return stored(met.mapInArrow(work, "a long, b long"), "neardup-links")


def _crowds(members: DataFrame, threshold: float) -> DataFrame:
    """``node, links`` (copies of others) of all members, ``component, node, copies, unit``, of components to be searched whole."""
    half = np.sqrt((1 + threshold) / 2) + 1e-9
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("blocks"))
    laid = stored(members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "neardup-members")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 8192):
                part = batch.slice(i, 8192)
                names, at = np.unique(part.column(0).to_numpy(), return_inverse=True)
                sums = np.zeros((len(names), len(part.column(1)[0].as_py()) // 8)) if len(part) else np.zeros((0, 1))
                np.add.at(sums, at, _rows(part.column(1), np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(names), _binary(sums)], ["component", "sum"])

    def mean(table: pa.Table) -> pa.Table:
        m = _rows(table["sum"], np.float64).sum(0)
        return pa.table({"component": table["component"].slice(0, 1), "mean": _binary((m / max(np.sqrt((m * m).sum()), 1e-300))[None])})

    sums = laid.select("component", "unit").mapInArrow(total, "component long, sum binary")  # summed up where the rows are read
    means = sums.groupBy("component").applyInArrow(mean, "component long, mean binary")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                near = (_rows(part.column(4), np.float64) * _rows(part.column(5), np.float64)).sum(1)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(near >= half)], ["component", "block", "node", "copies", "unit", "tight"])

    joined = laid.join(means, "component").select("component", "block", "node", "copies", "unit", "mean")
    judged = stored(joined.mapInArrow(place, "component long, block int, node long, copies long, unit binary, tight boolean"), "neardup-judged")
    tight = judged.filter("tight").groupBy("component").agg(F.sum("copies").alias("mass"))
    inside = judged.filter("tight").join(tight, "component").select("node", (F.col("mass") - F.col("copies")).alias("links"))

    wide = judged.filter("NOT tight").groupBy("component").agg(F.ceil(F.count(F.lit(1)) / LOOSE).alias("parts"))
    loose = judged.filter("NOT tight").join(wide, "component").join(sizes, "component")
    loose = loose.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("part"), "node", "copies", "unit")
    against = judged.join(wide, "component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).select("component", "block", "part", "node", "copies", "unit", "tight")
    against = against.toDF(*against.columns)  # both sides of the cogroup come from one table

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        x, y = _rows(left["unit"], np.float64), _rows(right["unit"], np.float64)
        ids, others = left["node"].to_numpy(), right["node"].to_numpy()
        mass, weights, tight = left["copies"].to_numpy(), right["copies"].to_numpy(), right["tight"].to_numpy(zero_copy_only=False)
        back, forth = np.zeros(len(y), np.int64), np.zeros(len(x), np.int64)
        for i in range(0, len(x), 256):
            linked = (x[i : i + 256] @ y.T >= threshold) & (ids[i : i + 256, None] != others[None])
            forth[i : i + 256] = linked @ weights
            back += mass[i : i + 256] @ linked
        return pa.table({"node": np.concatenate([ids, others[tight]]), "links": np.concatenate([forth, back[tight]])})

    outside = loose.groupBy("component", "block", "part").cogroup(against.groupBy("component", "block", "part")).applyInArrow(compare, "node long, links long")
    return stored(inside.unionAll(outside).groupBy("node").agg(F.sum("links").alias("links")), "neardup-crowds")


@dataclass
class Result:
    """``rows`` (``vec_id, n_links, component_id, kept``) and the share of the audited nodes' links that was found."""

    rows: DataFrame
    recall: float
    tables: int


def _audited(sample: pa.Table, nodes: DataFrame, threshold: float, counted: DataFrame) -> float:
    """Mean share of links found, of sampled nodes that have any, against brute force over all nodes."""
    if not sample.num_rows:
        return 1.0
    ids = sample["node"].to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast((ids, _rows(sample["unit"], np.float64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = shared.value
        links = np.zeros(len(asked), np.int64)
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                linked = (_rows(part.column(2), np.float64) @ q.T >= threshold) & (part.column(0).to_numpy()[:, None] != asked[None])
                links += part.column(1).to_numpy() @ linked
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(asked[some]), pa.array(links[some])], ["node", "true_links"])

    true = nodes.select("node", "copies", "unit").mapInArrow(work, "node long, true_links long").groupBy("node").agg(F.sum("true_links").alias("true_links"))
    share = F.coalesce("links", F.lit(0)) / F.col("true_links")
    return float(true.join(counted, "node", "left").agg(F.avg(share)).first()[0] or 1.0) if not true.isEmpty() else 1.0


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = RECALL, rounds: int = 8, waves: int = 5) -> Result:
    """Links of cosine ``threshold`` or more between all rows, their number by row and their components."""
    v = F.col("v")
    plain = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = usable(v) & F.exists(v, lambda x: x != 0)
    rows = plain.withColumn("v", F.when(fine, v))
    nodes, n = _nodes(rows.filter("v IS NOT NULL"))
    sample = nodes.orderBy(unit_hash(F.lit("audit"), F.col("id")), "node").limit(AUDIT).select("node", "unit").toArrow()
    lists, stars, tables, wave = None, None, 0, 0
    while True:
        more = TABLES << max(0, wave - 1)
        begun = _beginning(nodes, threshold, tables, more)
        tables += more
        found = begun.select("u", "v", "s", F.lit(True).alias("fresh"))
        lists = _merged(found if lists is None else found.unionAll(lists.withColumn("fresh", F.lit(False))))
        some = begun.filter("star").select("u", "v")
        stars = some if stars is None else stars.unionAll(some)
        reached = lists.filter(F.col("s") >= threshold - MARGIN).count()
        for _ in range(rounds):
            seen = _round(lists, nodes, threshold).withColumn("fresh", F.lit(True))
            lists = _merged(seen.unionAll(lists.withColumn("fresh", F.lit(False)).select("u", "v", "s", "fresh")))
            before, reached = reached, lists.filter(F.col("s") >= threshold - MARGIN).count()
            if reached - before <= reached // 1000:
                break
        near = lists.filter(F.col("s") >= threshold - MARGIN)
        pairs = near.select("u", "v").unionAll(stars).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        links = _verified(pairs, nodes, threshold)
        labels = stored(components(links), "neardup-components")
        saturated = near.groupBy("u").count().filter(F.col("count") >= LIST).select(F.col("u").alias("node"))
        crowded = labels.join(saturated, "node", "left_semi").select("component").distinct()
        members = labels.join(crowded, "component", "left_semi").join(nodes.select("node", "copies", "unit"), "node").select("component", "node", "copies", "unit")
        counts = _crowds(members, threshold)
        copies = nodes.select("node", "copies")
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        open_ = ends.join(copies.toDF("other", "weight"), "other").groupBy("node").agg(F.sum("weight").alias("links")).join(counts, "node", "left_anti")
        counted = stored(open_.select("node", "links").unionAll(counts.select("node", "links")), "neardup-counts")
        share = _audited(sample, nodes, threshold, counted)
        wave += 1
        if share >= recall or wave == waves:
            break
    named = nodes.select("node", "id", "copies", "v").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    links_of = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    classes = stored(named.join(smallest, "component").join(counted, "node", "left").select("v", links_of.alias("n_links"), "component_id"), "neardup-result")
    out = rows.join(classes, "v", "left").withColumns(
        {"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))}
    )
    return Result(out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")), share, tables)
