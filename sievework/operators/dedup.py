"""Duplicate removal over the whole table, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.text import has_token

IDENTIFIERS = ("registry_id", "npdes_id", "external_permit_nmbr", "activity_id")
TIME_WORDS = ("year", "date", "qtr", "quarter", "yearqtr")


def natural_keys(columns: list[str]) -> list[str]:
    """Identifiers the frame has, plus every column with a time word in its name."""
    keys = [c for c in IDENTIFIERS if c in columns]
    return keys + [c for c in columns if c not in keys and has_token(c, *TIME_WORDS)]


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by ``order``; null keys form a group of their own.

    Each task keeps its own first row per key before the shuffle (a group limit), so a key with a
    third of all rows sends one row per task.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") == 1).drop("_rank")


def keep_first_totalled(df: DataFrame, keys: list[str], order: list, totals: dict[str, Column]) -> DataFrame:
    """As :func:`keep_first`, and every kept row carries sums over all rows of its key.

    One aggregate does both, so measures of all rows and the rows that stay come from one scan and one
    shuffle; a key with a third of all rows still sends one row per task.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    kept = df.groupBy(*[F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(row, F.struct(*order)).alias("_kept"), *[F.sum(value).alias(name) for name, value in totals.items()]
    )
    return kept.select("_kept.*", *totals)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def remove_duplicates(df: DataFrame, order: list, keys: list[str] | None = None) -> DataFrame:
    """Keep the first row per natural key; without any key, drop rows equal in all columns."""
    keys = natural_keys(df.columns) if keys is None else keys
    return keep_first(df, keys, order) if keys else df.dropDuplicates()
