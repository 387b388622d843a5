"""Incremental load: new files -> transform -> QA gate -> staging, once per file."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.operators.findings import gate, store_findings
from sievework.plans.checkpoint import run_stage
from sievework.plans.transform import transform
from sievework.sources import runlog
from sievework.sources.catalog import Source
from sievework.sources.delimited import csv_options, header_of
from sievework.sources.tables import BATCH_COLUMN, ROW_KEY, Tables


class GateClosed(RuntimeError):
    """A batch did not pass QA; the stream stops and the batch is read again on restart."""


def file_stream(spark: SparkSession, path: str, source: Source, header: list[str] | None = None, files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder, with the columns of the first file there (the declared ones if there is none yet).

    Files are read as :func:`read_delimited` reads them and carry their place in ``_file`` and ``_block``.
    """
    if header is None:
        try:
            header = header_of(spark, path, source)
        except AnalysisException:
            header = list(source.columns)
    reader = spark.readStream.schema(source.schema(header or source.columns)).options(**csv_options(source))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def unseen(clean: DataFrame, source: Source, tables: Tables, batch_id: int) -> DataFrame:
    """Rows whose key no other batch has staged.

    The staged keys (one column) are first cut down to those of the batch, whose keys adaptive execution can
    broadcast while a batch is small; staging itself is then scanned and not shuffled.
    """
    if not tables.exists(source.staging_table, "staging"):
        return clean
    staged = tables.read(source.staging_table, "staging").filter(F.col(BATCH_COLUMN) != batch_id).select(ROW_KEY)
    met = staged.join(clean.select(ROW_KEY), ROW_KEY, "left_semi")
    return clean.join(met, ROW_KEY, "left_anti")


def ingest(
    stream: DataFrame, source: Source, tables: Tables, checkpoint: str, as_of: Callable[[], datetime] | datetime,
    table_type: str | None = None, enforce_gate: bool = True,
) -> StreamingQuery:
    """Process everything that is new and stop.

    The checkpoint folder remembers which files are done.  A batch runs under the id that the run log allots
    to this stream and its number: one that is repeated after a failure replaces itself, and two
    streams never share one.  Of rows with the same key the first in file order is staged, over all batches.
    """
    now = as_of if callable(as_of) else (lambda: as_of)
    spark = tables.spark

    def handle(batch: DataFrame, number: int) -> None:
        name = spark.read.json(f"{checkpoint}/metadata").first()["id"]
        batch_id = runlog.batch_of(tables, f"ingest_{source.name}", f"{name}:{number}", now(), source.title)
        if {"_file", "_block"}.issubset(batch.columns):
            batch = batch.withColumn("_row", F.monotonically_increasing_id())
        # Copies of the batch as files: what they are made from runs once, and their tasks follow the size of the batch
        # (a cached frame has as many as a shuffle, and waits in the executors' memory).
        place = f"{tables.base}/work/{source.name}-{batch_id}"
        try:
            whole = tables.copied(transform(batch, source, now(), key_as=ROW_KEY), f"{place}/whole")
            clean = unseen(whole, source, tables, batch_id)
            clean = clean if clean is whole else tables.copied(clean, f"{place}/clean")
            run = run_stage(clean.drop(ROW_KEY), source.name, table_type or source.staging_table, "load", now(), batch_id=batch_id)
            open_, message = gate(run.statistics)
            if enforce_gate and not open_:
                raise GateClosed(f"{source.name} batch {batch_id}: {message}")
            tables.stage(clean, source.staging_table, batch_id, source_file=source.title)
            store_findings(run.findings, tables, part=f"batch-{batch_id}")
            rows = clean.count()
            runlog.log_event(tables, batch_id, runlog.close_batch(spark, batch_id, "SUCCESS", now(), processed=rows, inserted=rows), "end")
        except Exception as problem:
            runlog.log_event(tables, batch_id, runlog.close_batch(spark, batch_id, "FAILED", now(), error=str(problem)), "end")
            raise
        finally:
            tables.forget(place)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
