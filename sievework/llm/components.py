"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import stored


#: At most so many links are joined by one task.
FEW = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links ``a, b`` and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        x, y = least[a], least[b]  # roots; the larger one of a link goes under the smaller one
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = least[least]
            if np.array_equal(above, least):
                break
            least = above
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[least]


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for links ``a, b``: the smallest node that can be reached.

    Up to ``FEW`` distinct links are joined by one task, whose memory that number bounds.  More take large-star and
    small-star steps in turn: every node first hands its larger neighbours to the smallest one, then its smaller ones,
    until all links are stars around the smallest node.  Each round's links are written to the shared folder.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.count() <= FEW:

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [[c.to_numpy() for c in batch.columns] for batch in batches]
            if held:
                found = least_reached(*(np.concatenate(x) for x in zip(*held)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "component"])

        return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(work, "node long, component long")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = stored(small.filter("u <> v").distinct(), "links")
        same = new.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(new, ["u", "v"], "left_anti").isEmpty()
        edges = new
        if same:
            break
    return nodes.join(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
