"""What the vector searches share: valid vectors, and Arrow columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """A list column as rows of ``width`` components; shorter ones are filled with zeros, longer ones cut by no row's own width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, int)
    out = np.zeros((len(column), width), kind)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def widest(column: pa.Array | pa.ChunkedArray) -> int:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return int(np.diff(column.offsets.to_numpy()).max()) if len(column) else 0


def ranked(found: DataFrame, k: int, best: Column) -> DataFrame:
    """The first ``k`` rows of each query by ``best`` and then the smaller ``vec_id``, with their ``rank`` from 1.

    Spark cuts each task's rows to ``k`` for each query before the shuffle.
    """
    order = Window.partitionBy("query_id").orderBy(best, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
