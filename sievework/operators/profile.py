"""Profiles of datasets: types, missing values, sparse columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.scoring import share

SPARSE_ABOVE = 0.5


def type_counts(df: DataFrame) -> DataFrame:
    """Columns per type; read off the schema, no job over the data."""
    counts: dict[str, int] = {}
    for entry in df.schema.fields:
        label = entry.dataType.simpleString()
        counts[label] = counts.get(label, 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "data_type string, column_count bigint")


def profile(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, columns, numeric and text columns, missing share, sparse columns (> 50 % null)."""
    fields = df.schema.fields
    counted = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count(F.col(f.name)).alias(f"n{i}") for i, f in enumerate(fields)])
    total = F.col("row_count")
    missing = F.array(*[total - F.col(f"n{i}") for i in range(len(fields))])
    sparse = F.array_compact(
        F.array(*[F.when(total - F.col(f"n{i}") > total * SPARSE_ABOVE, F.lit(f.name)) for i, f in enumerate(fields)])
    )
    all_missing = F.aggregate(missing, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return counted.select(
        F.lit(name).alias("dataset_name"),
        "row_count",
        F.lit(len(fields)).cast("bigint").alias("column_count"),
        F.lit(sum(isinstance(f.dataType, T.NumericType) for f in fields)).cast("bigint").alias("numeric_columns"),
        F.lit(sum(isinstance(f.dataType, T.StringType) for f in fields)).cast("bigint").alias("text_columns"),
        share(all_missing, total * len(fields)).alias("missing_percentage"),
        F.concat_ws(",", sparse).alias("sparse_columns"),
    )


def profile_all(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [profile(df, name) for name, df in frames.items()])


def totals(profiles: DataFrame) -> DataFrame:
    """Datasets, columns, rows and the mean missing share over several profiles."""
    return profiles.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.sum("column_count").alias("total_columns"),
        F.sum("row_count").alias("total_rows"),
        F.avg("missing_percentage").alias("average_missing_percentage"),
    )
