"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import settle

#: White space between words, as a Java and DuckDB character class (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at 16 MB, so that long texts don't fill a Python worker; a session's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) == "67108864b":  # the default
        spark.conf.set(name, "16m")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    small_batches(spark)
    base = spark.sparkContext.getCheckpointDir()
    if base is None:
        settle(spark.range(1))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    Nothing reads what was shuffled for it again, so those files go with the end of the write, not with some later
    garbage collection of the driver.
    """
    spark = df.sparkSession
    path, clean = scratch(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, also not in other letter case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def unit_hash(*parts: Column | str) -> Column:
    """60 evenly spread bits from the MD5 of the parts as text, computed alike in other SQL dialects."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def label_split(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets) or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bounds(column: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Row ranges of a batch whose texts add up to at most ``limit`` bytes each (one row at least)."""
    sizes = pc.binary_length(column).fill_null(0).to_pylist()
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            out.append((start, i))
            start, total = i, 0
        total += n
    return out + [(start, len(sizes))] if sizes else []


def sample_of(labels: DataFrame, label: str, eligible: Column, limit: int, seed: str = "fit") -> DataFrame:
    """At most ``limit`` labelled ids, ``doc_id, label``, in the order of a hash: the bounded sample a model is fitted on.

    Rows without id or label take no part; an id with several labels counts once, with the largest.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & eligible).groupBy("doc_id").agg(F.max(label).alias("label"))
    return rows.orderBy(unit_hash(F.lit(seed), F.col("doc_id")), "doc_id").limit(limit)
