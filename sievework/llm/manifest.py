"""A Merkle manifest: leaves of rows, a hash tree in each group, one tree over the groups, and a proof for every row.

A pass of the tree is one aggregate.  The nodes of a level have positions; conditional aggregates spread the nodes
below one ancestor into ``width`` slot columns, so that several levels of ``fanout`` cost one shuffle.  Concatenating
the columns of a run and hashing them gives the parent, leaving the own slot out gives the siblings.  Each pass is
written to the shared folder; then paths are handed down from the root, pass by pass, so that upper siblings are
joined to few rows and only the last step makes one for each row.  The rows of one group are spread over tasks: they
are placed by a range partitioning and the row counts of its parts, and every later key is (group, position).

Null columns are hashed as ``-``.  Rows of one group ascend by id, null first, then by leaf, so that different rows of
one id have a fixed order; equal rows are leaves of their own and exchangeable.  Texts of any length are hashed where
they are scanned and not shuffled.  An empty table gives no rows, and its root is null.  Other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import stored

#: Slots of a pass at most.
WIDTH = 16
_PART_BITS = 33  # monotonically_increasing_id has the partition above this bit

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*map(encoded, fields))


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the place from 0 within ``g``, and ``nodes``, the rows of ``g``; no group has to fit a task."""
    by = ["g", *order]
    laid = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "manifest-laid")
    part = F.shiftright("at", _PART_BITS)
    runs = laid.groupBy("g", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("g", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("nodes"))
    return laid.withColumn("part", part).join(runs, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "shift", "at")


@dataclass
class Tree:
    """The passes of a forest of one tree for each ``g``, lowest first, and its ``tops`` (``g, hash``)."""

    passes: list[DataFrame]
    tops: DataFrame
    fanout: int
    levels: int

    @property
    def width(self) -> int:
        return self.fanout**self.levels


def _many(level: int, fanout: int) -> str:
    """Whether the whole group has more than one node ``level`` levels above the pass."""
    return f"ceil(nodes / {fanout**level}) > 1"


def grow(nodes: DataFrame, fanout: int = 2) -> Tree:
    """The trees over ``g, pos, nodes, hash`` and further columns, which the lowest pass carries in its slots.

    The columns are made from texts of SQL, as there are many of them.
    """
    levels = 1
    while fanout ** (levels + 1) <= WIDTH:
        levels += 1
    width = fanout**levels
    most = nodes.agg(F.max("nodes")).first()[0] or 1
    held = ", ".join(c for c in nodes.columns if c not in ("g", "pos", "nodes"))
    passes = []
    while True:
        spread = nodes.groupBy("g", "nodes", F.expr(f"floor(pos / {width})").alias("pos")).agg(
            *[F.expr(f"max(CASE WHEN pmod(pos, {width}) = {i} THEN struct({held}) END)").alias(f"s{i}") for i in range(width)]
        )
        grown = spread.selectExpr("*", *[f"s{i}.hash AS h0_{i}" for i in range(width)])
        for level in range(levels):
            above = []
            for p in range(width // fanout ** (level + 1)):
                run = [f"h{level}_{p * fanout + i}" for i in range(fanout)]
                joined = "sha2(concat(" + ", ".join(f"coalesce({c}, '')" for c in run) + "), 256)"
                above.append(f"CASE WHEN NOT {_many(level, fanout)} THEN {run[0]} WHEN {run[0]} IS NOT NULL THEN {joined} END AS h{level + 1}_{p}")
            grown = grown.selectExpr("*", *above)
        tables = ["array(" + ", ".join(f"h{level}_{i}" for i in range(width // fanout**level)) + f") AS level{level}" for level in range(levels)]
        slots = "array(" + ", ".join(f"s{i}" for i in range(width)) + ") AS slots"
        passes.append(stored(grown.selectExpr("g", "nodes", "pos", slots, *tables, f"h{levels}_0 AS hash"), "manifest-pass"))
        most = -(-most // width)
        nodes = passes[-1].selectExpr("g", "pos", f"ceil(nodes / {width}) AS nodes", "hash")
        held = "hash"
        if most <= 1:
            return Tree(passes, nodes.select("g", "hash"), fanout, levels)


def descend(tree: Tree, paths: DataFrame) -> DataFrame:
    """Hand ``paths`` (``g, path`` and further columns of each tree's top) down to the leaves.

    ``path`` lists for every level from the leaf up what is concatenated before and after the node.  Returns ``slot``
    (the leaf's columns), ``path`` and the further columns.
    """
    f, more = tree.fanout, [c for c in paths.columns if c not in ("g", "path")]
    paths = paths.withColumn("pos", F.lit(0).cast("long"))
    entries = []
    for level in range(tree.levels):
        place = f"int(at / {f**level})"
        before = f"array_join(slice(level{level}, {place} - {place} % {f} + 1, {place} % {f}), '')"
        after = f"array_join(slice(level{level}, {place} + 2, {f - 1} - {place} % {f}), '')"
        entries.append(f"CASE WHEN {_many(level, f)} THEN struct({before} AS before, {after} AS after) END")
    longer = f"concat(array_compact(array({', '.join(entries)})), path) AS path"
    for number, held in enumerate(reversed(tree.passes)):
        each = held.join(paths, ["g", "pos"]).selectExpr("*", "posexplode(slots) AS (at, slot)").filter("slot IS NOT NULL")
        if number < len(tree.passes) - 1:
            paths = each.selectExpr("g", f"pos * {tree.width} + at AS pos", longer, *more)
    return each.selectExpr("slot", longer, *more)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", fanout: int = 2, tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """``id, leaf, subroot, root, path, proof_sha256, folded_root, verified`` of every row.

    Where ``when`` holds, the row that is checked has the columns of ``tampered`` in place of its own.
    """
    own = leaf([F.col(c) for c in fields])
    found = own
    if tampered is not None:
        changed = leaf([tampered.get(c, F.col(c)) for c in fields])
        found = F.when(when, changed).otherwise(F.lit(None)) if when is not None else changed
    # A null group goes first; the mark keeps the order of the others, byte by byte.
    g = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = stored(docs.select(g.alias("g"), F.col(order).alias("id"), own.alias("hash"), (found if tampered is not None else F.lit(None).cast("string")).alias("found")), "manifest-leaves")
    tree = grow(_placed(leaves, ["id", "hash"]), fanout)
    tops = stored(tree.tops, "manifest-subroots")
    upper = grow(_placed(tops.select(F.lit("").alias("g"), F.col("g").alias("key"), "hash"), ["key"]), fanout)
    top = upper.tops.first()
    start = docs.sparkSession.range(1).selectExpr("'' AS g", "CAST(array() AS array<struct<before: string, after: string>>) AS path")
    groups = descend(upper, start).select(F.col("slot.key").alias("g"), "path", F.col("slot.hash").alias("subroot"))
    rows = descend(tree, stored(groups, "manifest-groups"))
    root = F.lit(top["hash"] if top else None).cast("string")
    begin = F.coalesce("slot.found", "slot.hash")
    folded = F.aggregate("path", begin, lambda value, e: digest(e["before"], value, e["after"]))
    proof = F.sha2(F.array_join(F.transform("path", lambda e: F.concat(e["before"], e["after"])), "").cast("binary"), 256)
    out = rows.select(F.col("slot.id").alias("id"), F.col("slot.hash").alias("leaf"), "subroot", root.alias("root"), "path", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
