"""Raw extract to flagged rows, as one lazy chain with a single shuffle (the duplicate removal)."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scoring import share
from sievework.operators import cleaning
from sievework.operators.dedup import keep_first_totalled, natural_keys, remove_duplicates
from sievework.sources.catalog import Source
from sievework.sources.delimited import ORDER_COLUMNS
from sievework.sources.tables import stable_key


def order_of(df: DataFrame) -> list:
    """File order when the scan carries it, else all columns, which is at least repeatable."""
    if set(ORDER_COLUMNS).issubset(df.columns):
        return list(ORDER_COLUMNS)
    return [c for c in df.columns if not c.startswith("_")]


def before_dedup(df: DataFrame, source: Source) -> DataFrame:
    coordinates = source.snake(source.coordinates)
    return (
        df.transform(cleaning.rename_columns)
        .transform(cleaning.typed_columns, source)
        .transform(cleaning.clean_coordinates, coordinates)
        .transform(cleaning.standard_identifiers)
        .transform(cleaning.clean_names)
        .transform(cleaning.mark_missing, source.snake(source.required))
        .transform(cleaning.default_values)
    )


def after_dedup(df: DataFrame, source: Source, as_of: datetime) -> DataFrame:
    """Scores, region and units on the surviving rows, then the row flags."""
    if source.name == "npdes_measurements":
        df = df.transform(cleaning.score_compliance)
    if source.coordinates:
        df = df.transform(cleaning.derive_region)
    return (
        df.transform(cleaning.standard_units)
        .transform(cleaning.apply_declared_ranges, source, as_of.year)
        .transform(cleaning.quality_flags, source.snake(source.coordinates), as_of)
    )


def row_keys(ready: DataFrame, source: Source) -> list[str]:
    """What tells one row from another: the declared key, else the natural one of the columns."""
    return source.snake(source.row_key) or natural_keys([c for c in ready.columns if not c.startswith("_")])


def transform(df: DataFrame, source: Source, as_of: datetime, key_as: str | None = None) -> DataFrame:
    """The whole transformation of one source; ``as_of`` stands for now.

    ``key_as`` names a column for a hash of the row key as it was when duplicates were removed, before
    declared ranges empty any part of it.
    """
    ready = before_dedup(df, source)
    keys = row_keys(ready, source)
    kept = remove_duplicates(ready, order_of(ready), keys)
    if key_as is not None:
        kept = kept.withColumn(key_as, stable_key(*(keys or [c for c in ready.columns if not c.startswith("_")])))
    return after_dedup(kept, source, as_of).drop(*ORDER_COLUMNS)


def filled_share(df: DataFrame, columns: list[str]) -> Column:
    """Share of non-null cells, as an aggregate."""
    cells = sum((F.count(F.col(f"`{c}`")) for c in columns), F.lit(0))
    return F.coalesce(F.try_divide(cells.cast("double"), F.count(F.lit(1)) * len(columns)), F.lit(0.0))


def transform_stats(raw: DataFrame, source: Source, as_of: datetime) -> DataFrame:
    """One row: input and output rows, duplicates, flagged rows, retention, completeness before and
    after. The completeness after is measured, not estimated.

    One scan and one shuffle of rows: the aggregate that removes duplicates also adds up, into the row that stays, the
    rows, filled cells and marks of all rows of its key.  (Metrics observed while a run writes would count
    a map task again whose executor is lost; an aggregate does not.)
    """
    content = [c for c in raw.columns if not c.startswith("_")]
    filled = reduce(add, [F.col(f"`{c}`").isNotNull().cast("int") for c in content])
    ready = before_dedup(raw.withColumn("_cells", filled), source)
    marks = F.col(cleaning.MISSING_REQUIRED).cast("int") + F.col(cleaning.INVALID_COORDINATES).cast("int")
    totals = {"_rows_in": F.lit(1), "_cells_in": F.col("_cells"), "_marks_in": marks}
    # Without a key only rows equal in all columns are duplicates, so any of them stays.
    keys = row_keys(ready, source) or [c for c in ready.columns if c != "_cells"]
    kept = keep_first_totalled(ready, keys, order_of(ready) or keys, totals)
    out = after_dedup(kept, source, as_of).drop(*ORDER_COLUMNS)
    measured = [c for c in out.columns if c not in totals and c != "_cells"]
    rows_in = F.coalesce(F.sum("_rows_in"), F.lit(0))
    row = out.agg(
        rows_in.alias("input_rows"), F.count(F.lit(1)).alias("output_rows"), F.coalesce(F.sum("_marks_in"), F.lit(0)).alias("rows_flagged"),
        F.coalesce(F.try_divide(F.sum("_cells_in").cast("double"), rows_in * len(content)), F.lit(0.0)).alias("completeness_before"),
        filled_share(out, measured).alias("completeness_after"),
    ).select(F.lit(source.name).alias("source_name"), "*")
    return row.withColumns(
        {
            "duplicates_removed": F.col("input_rows") - F.col("output_rows"),
            "retention": share(F.col("output_rows"), F.col("input_rows")),
            "improvement": share(F.col("completeness_after") - F.col("completeness_before"), F.col("completeness_before")),
        }
    )


def transform_totals(stats: DataFrame) -> DataFrame:
    """Totals over the statistics rows of several sources."""
    return stats.agg(
        F.count(F.lit(1)).alias("total_sources"), F.sum("input_rows").alias("total_input_rows"),
        F.sum("output_rows").alias("total_output_rows"), F.sum("duplicates_removed").alias("total_duplicates_removed"),
        share(F.sum("output_rows"), F.sum("input_rows")).alias("overall_retention"),
        F.avg("improvement").alias("average_improvement"),
    )
