"""Registration of queries and helpers shared by them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
AS_OF = datetime(2024, 1, 31)
TODAY = date(2024, 1, 31)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frame(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """A frame from SQL text over the given tables."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(text)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show; minus zero becomes zero."""
    return df.select(
        *[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint location, for queries that write tables or streams."""
    from sievework.session import settle

    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        settle(spark.range(1))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/sievework-{uuid.uuid4().hex}"
