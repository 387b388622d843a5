"""Event-time forms of duplicate removal, SLA breaches and the dashboard.

Every function takes a streaming or a plain frame: the plan is the same, a stream adds the watermark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.operators.dedup import keep_last
from sievework.operators.runs import DEFAULT_SLAS, Sla, sla_checks


def with_event_time(df: DataFrame, time: str, delay: str) -> DataFrame:
    """Event time as timestamp, with a watermark on streams."""
    typed = df.withColumn(time, F.col(time).cast("timestamp"))
    return typed.withWatermark(time, delay) if df.isStreaming else typed


def drop_repeats(df: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """One row per key across batches; state is kept only as long as repeats can still arrive."""
    timed = with_event_time(df, time, delay)
    return timed.dropDuplicatesWithinWatermark(keys) if df.isStreaming else timed.dropDuplicates(keys)


def sla_windows(metrics: DataFrame, slas: tuple[Sla, ...] = DEFAULT_SLAS, delay: str = "10 minutes") -> DataFrame:
    """Breaches per agreement and tumbling window; a window alerts from the tolerated count on.

    Each agreement has its own window length.  Events are counted per window inside each task first.
    """
    timed = with_event_time(metrics, "ts", delay)
    judged = sla_checks(timed, slas)
    parts = []
    for minutes in sorted({s.window_minutes for s in slas}):
        mine = [s for s in slas if s.window_minutes == minutes]
        tolerated = F.lit(None).cast("int")
        for s in mine:
            tolerated = F.when(F.col("metric_name") == s.name, s.tolerated_breaches).otherwise(tolerated)
        counted = (
            judged.filter(F.col("metric_name").isin(*[s.name for s in mine]))
            .groupBy(F.window("ts", f"{minutes} minutes"), "metric_name")
            .agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("compliant")).alias("breaches"), F.max("metric_value").alias("worst_value"))
        )
        parts.append(
            counted.select(
                F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "metric_name", "checks",
                "breaches", "worst_value", ((F.col("breaches") > 0) & (F.col("breaches") >= tolerated)).alias("alert"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def dashboard_windows(events: DataFrame, minutes: int = 60, keys: tuple[str, ...] = (), delay: str = "10 minutes") -> DataFrame:
    """Executed, failed and mean duration per window."""
    timed = with_event_time(events, "ts", delay)
    done = F.col("status").isin("COMPLETED", "SUCCESS")
    counted = timed.groupBy(F.window("ts", f"{minutes} minutes"), *keys).agg(
        F.count_if(done).alias("executed"),
        F.count_if(F.col("status") == "FAILED").alias("failures"),
        F.avg(F.when(done, F.col("duration_seconds"))).alias("average_duration"),
    )
    return counted.select(F.col("window.start").alias("window_start"), *keys, "executed", "failures", "average_duration")


def write_updates(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "update") -> StreamingQuery:
    """Process everything that is new and stop; every batch writes its changed rows.

    A batch overwrites its own folder, so a batch repeated after a failure replaces itself.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/update_batch={batch_id}")

    return (
        stream.writeStream.outputMode(output_mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Current row of every key from the written updates."""
    return keep_last(updates, keys, ["update_batch"]).drop("update_batch")
