"""Checks on loaded tables: integrity, completeness, freshness, throughput, and their roll-up.

Every check is a row (table_name, check_name, value, status); one table costs one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import codes
from sievework.functions.scoring import outside, share

COMPLETE_FROM = 80.0
FAST_ABOVE = 1000.0
FRESH_DAYS = 7
THROUGHPUT_HOURS = 24


def integrity(
    df: DataFrame, table: str, primary_key: str | None = None, required: Sequence[str] = (),
    latitude: str | None = None, longitude: str | None = None,
) -> DataFrame:
    """Rows without any value, key duplicates, missing fields, bad coordinates, and mean completeness of
    all columns, all in one pass."""
    rows = F.count(F.lit(1))
    checks: list[tuple[str, Column, str]] = [
        ("null_rows", F.count_if(reduce(and_, [F.col(c).isNull() for c in df.columns])), "WARN")
    ]
    if primary_key:
        checks.append(("primary_key_duplicates", F.count(F.col(primary_key)) - F.count_distinct(F.col(primary_key)), "FAIL"))
    checks += [(f"missing_{c}", F.count_if(F.col(c).isNull()), "WARN") for c in required if c in df.columns]
    if latitude:
        checks.append(("invalid_latitude", F.count_if(outside(F.col(latitude), codes.LATITUDE_RANGE)), "FAIL"))
    if longitude:
        checks.append(("invalid_longitude", F.count_if(outside(F.col(longitude), codes.LONGITUDE_RANGE)), "FAIL"))
    filled = reduce(add, [share(F.count(F.col(c)), rows) for c in df.columns]) / len(df.columns)
    counted = df.agg(*[c.cast("double").alias(f"c{i}") for i, (_, c, _) in enumerate(checks)], filled.alias("filled"))
    cells = [
        F.struct(
            F.lit(name).alias("check_name"), F.col(f"c{i}").alias("value"),
            F.when(F.col(f"c{i}") == 0, "PASS").otherwise(worse).alias("status"),
        )
        for i, (name, _, worse) in enumerate(checks)
    ]
    cells.append(
        F.struct(
            F.lit("average_completeness").alias("check_name"), F.col("filled").alias("value"),
            F.when(F.col("filled") >= COMPLETE_FROM, "PASS").otherwise("WARN").alias("status"),
        )
    )
    return counted.select(F.lit(table).alias("table_name"), F.inline(F.array(*cells)))


def null_violations(df: DataFrame, table: str, not_null: Sequence[str]) -> DataFrame:
    """NOT NULL columns that hold nulls, with counts."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in not_null])
    return counted.select(F.lit(table).alias("table_name"), F.inline(cells)).filter("null_count > 0")


def freshness(runs: DataFrame, as_of: datetime, days: int = FRESH_DAYS) -> DataFrame:
    """Last successful run and number of runs per process within the last days, newest first."""
    recent = runs.filter((F.col("status") == "SUCCESS") & (F.col("end_time") >= F.lit(as_of - timedelta(days=days))))
    return recent.groupBy("process_name").agg(F.max("end_time").alias("last_run"), F.count(F.lit(1)).alias("run_count")).orderBy(
        F.col("last_run").desc(), "process_name"
    )


def throughput(runs: DataFrame, as_of: datetime, hours: int = THROUGHPUT_HOURS) -> DataFrame:
    """Mean records, duration and rate per process over the last hours; PASS above 1000 records/s."""
    recent = runs.filter(
        (F.col("status") == "SUCCESS") & (F.col("records_processed") > 0) & (F.col("end_time") >= F.lit(as_of - timedelta(hours=hours)))
    )
    seconds = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1_000_000
    rated = recent.groupBy("process_name").agg(
        F.avg("records_processed").alias("avg_records"),
        F.avg(seconds).alias("avg_duration_seconds"),
        F.avg(F.try_divide(F.col("records_processed"), F.nullif(seconds, F.lit(0.0)))).alias("avg_records_per_second"),
        F.count(F.lit(1)).alias("run_count"),
    )
    status = F.when(F.col("avg_records_per_second") > FAST_ABOVE, "PASS").otherwise("WARN")
    return rated.withColumn("status", status).orderBy(F.col("avg_records_per_second").desc_nulls_last(), "process_name")


def roll_up(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks of all tables, with the verdict of each table: FAIL when any of its checks fails."""
    listed = reduce(DataFrame.unionByName, checks)
    verdicts = listed.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "WARN").alias("warned"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
    )
    return verdicts.withColumn("overall_status", F.when(F.col("failed") > 0, "FAIL").otherwise("PASS"))


def relationship_check(consistency: DataFrame, name: str) -> DataFrame:
    """A key-consistency row in the shape of the other checks."""
    return consistency.select(
        F.lit(name).alias("table_name"), F.lit("unmatched_rows").alias("check_name"),
        F.col("unmatched_rows").cast("double").alias("value"), "status",
    )
