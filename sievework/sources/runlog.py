"""The run log: a table of run events, a part for each batch and event, and the views derived from it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.codes import RUN_STATUSES

RUN_LOG = "etl_run_log"
RUN_SCHEMA = (
    "batch_id bigint, process_name string, source_file_name string, start_time timestamp, "
    "end_time timestamp, status string, records_processed bigint, records_inserted bigint, "
    "records_updated bigint, records_failed bigint, error_message string, run_parameters string, "
    "event_time timestamp"
)


def _event(spark: SparkSession, **values) -> DataFrame:
    if values["status"] not in RUN_STATUSES:
        raise ValueError(f"Unknown run status: {values['status']}")
    names = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(values.get(n) for n in names)], RUN_SCHEMA)


def open_batch(
    spark: SparkSession, batch_id: int, process: str, at: datetime, source_file: str | None = None, parameters: str | None = None
) -> DataFrame:
    """The RUNNING event of a batch."""
    return _event(
        spark, batch_id=batch_id, process_name=process, source_file_name=source_file, start_time=at,
        status="RUNNING", records_processed=0, records_inserted=0, records_updated=0, records_failed=0,
        run_parameters=parameters, event_time=at,
    )


def close_batch(
    spark: SparkSession, batch_id: int, status: str, at: datetime, processed: int = 0, inserted: int = 0,
    updated: int = 0, failed: int = 0, error: str | None = None,
) -> DataFrame:
    """The final event of a batch: status and counts."""
    return _event(
        spark, batch_id=batch_id, status=status, end_time=at, records_processed=processed,
        records_inserted=inserted, records_updated=updated, records_failed=failed, error_message=error,
        event_time=at,
    )


def log_event(tables, batch_id: int, event: DataFrame, moment: str) -> None:
    """Write the ``open`` or ``end`` event of a batch; a repeated batch replaces its own."""
    tables.put(event, RUN_LOG, f"batch-{batch_id}-{moment}")


def batch_of(tables, process: str, key: str, at: datetime, source_file: str | None = None) -> int:
    """The id of the batch that ``key`` stands for within a process, opened in the run log.

    A key that ran before finds its own id again, so a repeated batch replaces what it wrote.  A new one
    gets the next id nobody has claimed, whichever stream or load asks.
    """
    last = 0
    if tables.exists(RUN_LOG):
        mine = (F.col("process_name") == process) & (F.col("run_parameters") == key)
        row = tables.read(RUN_LOG).agg(F.min(F.when(mine, F.col("batch_id"))).alias("known"), F.max("batch_id").alias("last")).first()
        if row["known"] is not None:
            return row["known"]
        last = row["last"] or 0
    batch_id = last + 1
    while not tables.claim(f"batch-{batch_id}"):
        batch_id += 1
    log_event(tables, batch_id, open_batch(tables.spark, batch_id, process, at, source_file, key), "open")
    return batch_id


def numbered(tables, batch_id: int, process: str, at: datetime, source_file: str | None = None) -> int:
    """Open a batch under a number the caller chose; one that another process holds is refused."""
    if not tables.claim(f"batch-{batch_id}"):
        held = tables.read(RUN_LOG).filter((F.col("batch_id") == batch_id) & (F.col("process_name") != process)) if tables.exists(RUN_LOG) else None
        if held is not None and not held.isEmpty():
            raise ValueError(f"batch {batch_id} belongs to another process")
    log_event(tables, batch_id, open_batch(tables.spark, batch_id, process, at, source_file), "open")
    return batch_id


def current_runs(events: DataFrame) -> DataFrame:
    """Latest state of every batch; values a later event leaves open come from an earlier one.

    Of two events at the same moment the one that ends the run is the later.

    Partial aggregation keeps one candidate per batch and task, so a chatty batch moves no more rows
    than a quiet one.
    """
    moment = F.struct("event_time", F.col("status") != "RUNNING")

    def latest(name: str):
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), moment)).alias(name)

    names = [c for c in events.columns if c not in ("batch_id", "event_time")]
    return events.groupBy("batch_id").agg(*[latest(n) for n in names])


def extraction_summary(runs: DataFrame) -> DataFrame:
    """Rows, errors, warnings, duration and rate per source."""
    seconds = F.unix_timestamp("end_time") - F.unix_timestamp("start_time")
    return runs.groupBy("source").agg(
        F.sum("rows").alias("total_rows"),
        F.sum("errors").alias("error_count"),
        F.sum("warnings").alias("warning_count"),
        F.sum(seconds).cast("double").alias("duration_seconds"),
        F.try_divide(F.sum("rows"), F.sum(seconds)).alias("rows_per_second"),
    )


def last_events(events: DataFrame, time: str, tie: str, count: int = 10) -> DataFrame:
    """The last ``count`` events; a top-k, so only ``count`` rows per task reach the driver side."""
    return events.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(count)


def last_events_per(events: DataFrame, keys: list[str], time: str, tie: str, count: int = 10) -> DataFrame:
    """The last ``count`` events of every group, cut inside each task before the shuffle."""
    recent = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(tie).desc())
    return events.withColumn("recency", F.row_number().over(recent)).filter(F.col("recency") <= count)
