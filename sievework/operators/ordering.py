"""Row order at scale: dense positions within a series, and buckets with overlapping edges.

A window over one long series would put that series into one task.  Here the rows are range
partitioned on (series, order), so a series that holds a third of the table is spread over a third
of the tasks; positions come from per-partition run lengths, and neighbour look-ups use buckets of
bounded length that carry a few copied rows at their edges.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievework.session import settle

BUCKET_ROWS = 1_000_000
_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def dealt_out(df: DataFrame) -> DataFrame:
    """The same rows, dealt out by a hash of their content before costly work on each of them.

    A big file of short rows is few scan tasks.  No sort is needed, as rows go to the same place when a task is
    repeated, and adaptive execution splits a place that many equal rows fill.
    """
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return df.withColumn("_deal", F.xxhash64(*[F.col(f"`{c}`") for c in plain])).hint("rebalance", "_deal").drop("_deal")


def longest_series(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest series. Collects one number."""
    if keys:
        counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
    else:
        counted = df.agg(F.count(F.lit(1)))
    return counted.first()[0] or 0


def positions(df: DataFrame, keys: list[str], order: list[str], bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """Add ``position`` (from 0, within the series) and ``series_rows``; also return the longest series.

    ``order`` has to be unique within a series.  Series that fit a bucket take a plain window and one
    shuffle; longer ones take the range-partitioned way.
    """
    longest = longest_series(df, keys)
    if longest > bucket_rows:
        return _spread_positions(df, keys, order), longest
    series = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    placed = df.withColumns(
        {
            "position": F.row_number().over(series.orderBy(*order)).cast("bigint") - 1,
            "series_rows": F.count(F.lit(1)).over(series),
        }
    )
    return placed, longest


def dense_positions(df: DataFrame, order: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Dense numbers from 0 over the whole frame."""
    placed, _ = positions(df, [], order, bucket_rows)
    return placed.drop("series_rows")


def _spread_positions(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    by = [*keys, *order]
    laid = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_laid", F.monotonically_increasing_id())
    laid = settle(laid)
    laid = laid.withColumns(
        {
            "_part": F.shiftright("_laid", _SLOT_BITS),
            "_slot": F.col("_laid").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)),
        }
    )
    # One row per series and partition: distinct series plus partitions, whatever the skew.
    runs = laid.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_run"), F.min("_slot").alias("_first"))
    series = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    earlier = series.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys],
        F.col("_part").alias("_of_part"),
        (F.coalesce(F.sum("_run").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_run").over(series).alias("series_rows"),
    )
    match = [laid["_part"] == runs["_of_part"]] + [laid[k].eqNullSafe(runs[f"_of_{k}"]) for k in keys]
    joined = laid.join(runs, reduce(and_, match))
    return joined.select(*df.columns, (F.col("_slot") + F.col("_shift")).alias("position"), "series_rows")


def bucketed(rows: DataFrame, longest: int, before: int, after: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``bucket`` and ``at_home``: buckets of bounded length with copies of nearby rows.

    Every bucket also gets the ``before`` rows in front of it and the ``after`` rows behind it, marked
    ``at_home = false``.  Series within one bucket get no copies.
    """
    if longest <= bucket_rows:
        return rows.withColumns({"bucket": F.lit(0).cast("bigint"), "at_home": F.lit(True)})
    home = F.floor(F.col("position") / bucket_rows)
    last = F.floor((F.col("series_rows") - 1) / bucket_rows)
    offset = F.col("position") - home * bucket_rows
    placed = F.array(
        home,
        F.when((offset < after) & (home > 0), home - 1),
        F.when((offset >= bucket_rows - before) & (home < last), home + 1),
    )
    spread = rows.withColumn("bucket", F.explode(F.array_compact(placed)))
    return spread.withColumn("at_home", F.col("bucket") == home)


def series_window(keys: list[str]):
    return Window.partitionBy(*[F.col(k) for k in keys], F.col("bucket")).orderBy("position")


def neighbours(value: Column, window, first: int, last: int) -> dict[int, Column]:
    """``{offset: value at that offset}`` for offsets ``first``..``last``; null past the ends."""
    return {d: F.lag(value, -d).over(window) if d < 0 else F.lead(value, d).over(window) if d else value for d in range(first, last + 1)}
