"""Lineage records: which source column fed which target column, how, and with how many rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.codes import LINEAGE_TYPES
from sievework.sources.catalog import CoreTable


def lineage_rows(table: CoreTable, columns: list[str]) -> list[tuple[str, str, str, str]]:
    """(source column, target column, kind, logic) of every mapped column the staging frame has."""
    rows = []
    for staged, target in table.mapping.items():
        if staged not in columns:
            continue
        if isinstance(target, tuple):
            rows += [(staged, t, "SPLIT", f"part {i + 1} of {staged}") for i, t in enumerate(target)]
        elif target.startswith(("is_", "has_")):
            rows.append((staged, target, "DERIVED", f"{staged} is Y"))
        else:
            rows.append((staged, target, "DIRECT_COPY", staged))
    rows += [(key, column, "LOOKUP", f"{parent}.{column} by {key}") for column, (parent, key) in table.foreign.items()]
    return rows


def lineage(spark: SparkSession, table: CoreTable, staged: DataFrame, loaded: DataFrame, batch_id: int, at: datetime) -> DataFrame:
    """Lineage of one load; both row counts are computed in the plan."""
    rows = lineage_rows(table, staged.columns)
    assert all(kind in LINEAGE_TYPES for _, _, kind, _ in rows)
    frame = spark.createDataFrame(
        rows, "source_column string, target_column string, transformation_type string, transformation_logic string"
    )
    return frame.select(
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.lit(table.staging_table).alias("source_table"),
        "source_column",
        F.lit(table.name).alias("target_table"),
        "target_column",
        "transformation_type",
        "transformation_logic",
        staged.agg(F.count(F.lit(1))).scalar().alias("source_record_count"),
        loaded.agg(F.count(F.lit(1))).scalar().alias("target_record_count"),
        F.lit(at).alias("transformation_date"),
    )
