"""Streaming forms over the event table as a file stream; each runs until everything is read."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sievework.sources.catalog import source
from sievework.sources.tables import Tables
from sievework.streaming import ingest, windows
from sievework.suite.cleaning import RAW_MEASUREMENTS
from sievework.suite.frames import RUNS
from sievework.suite.registry import SQL, AS_OF, frame, query, rounded, scratch, table
from sievework.suite.runs import DASHBOARD, METRICS, SLA_WINDOWS


def event_stream(spark, sf, text: str | None = None):
    """The events as a stream, shaped by the given text."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    if text is None:
        return stream
    return spark.sql(text.replace("FROM events", "FROM {events}"), events=stream)


def updates(spark, stream):
    path = scratch(spark)
    windows.write_updates(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query("stream_sla_windows", SLA_WINDOWS)
def stream_sla_windows(spark, sf):
    rows = windows.latest_updates(updates(spark, windows.sla_windows(event_stream(spark, sf, METRICS))), ["window_start", "metric_name"])
    return rounded(rows.withColumn("window_start", F.col("window_start").cast("string")).drop("window_end"))


@query("stream_dashboard", DASHBOARD)
def stream_dashboard(spark, sf):
    counted = windows.dashboard_windows(event_stream(spark, sf, RUNS), 60, ("process_name",))
    rows = windows.latest_updates(updates(spark, counted), ["window_start", "process_name"])
    return rounded(rows.withColumn("window_start", F.col("window_start").cast("string")))


@query("stream_dedup", "SELECT event_id, user_id, value FROM events")
def stream_dedup(spark, sf):
    """Every event arrives twice and is kept once."""
    twice = event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = windows.drop_repeats(twice, ["event_id"], "ts", "40 days").select("event_id", "user_id", "value")
    path = scratch(spark)
    windows.write_updates(kept, f"{path}/rows", f"{path}/checkpoint", "append").awaitTermination()
    return spark.read.parquet(f"{path}/rows").drop("update_batch")


def measurement_files(spark, sf, path: str, times: int = 1, text: str = RAW_MEASUREMENTS) -> None:
    """Extract files; all rows of a key are in one of them, in the order the SQL takes the first by."""
    whole = [F.expr(f"try_cast({c} AS BIGINT)") for c in ("NUME90Q", "NUMCVDT")]
    rows = frame(spark, sf, text).repartition("NPDES_ID", "YEARQTR").sortWithinPartitions("NPDES_ID", "YEARQTR", "HLRNC", *whole).persist()
    for _ in range(times):
        rows.write.mode("append").option("header", True).csv(path)
    rows.unpersist()


def ingested(spark, tables: Tables, inputs: str, checkpoint: str, files_per_batch: int | None = None):
    config = source("npdes_measurements")
    stream = ingest.file_stream(spark, inputs, config, files_per_batch=files_per_batch)
    ingest.ingest(stream, config, tables, checkpoint, AS_OF, "water_measurements", enforce_gate=False).awaitTermination()


@query("stream_ingest", SQL["transform_measurements"])
def stream_ingest(spark, sf):
    """Many files, each there twice, are transformed, judged and staged batch by batch; starting again finds nothing new.

    The first row of a key in file order stays, whichever batch a repeat comes in.
    """
    path = scratch(spark)
    measurement_files(spark, sf, f"{path}/in", times=2)
    tables, files = Tables(spark, f"{path}/tables"), spark.read.text(f"{path}/in").select("_metadata.file_path").distinct().count()
    for _ in range(2):
        ingested(spark, tables, f"{path}/in", f"{path}/checkpoint", files_per_batch=-(-files // 2))
    staged = tables.read("npdes_measurements", "staging")
    return rounded(staged.select("npdes_id", "yearqtr", "hlrnc", "nume90_q", "numcvdt", "compliance_score", "data_quality_score", "data_quality_flags"))


_HALVES = [RAW_MEASUREMENTS + f" WHERE {test} o_orderstatus = 'O'" for test in ("NOT", "")]


@query(
    "staging_two_streams",
    f"""WITH a AS ({_HALVES[0]}), b AS ({_HALVES[1]}), ka AS (SELECT DISTINCT NPDES_ID, YEARQTR FROM a), kb AS (SELECT DISTINCT NPDES_ID, YEARQTR FROM b)
    SELECT 'first' AS stream, count(*) AS rows FROM ka
    UNION ALL SELECT 'second', count(*) FROM kb WHERE NOT EXISTS (SELECT 1 FROM ka WHERE ka.NPDES_ID = kb.NPDES_ID AND ka.YEARQTR = kb.YEARQTR)""",
)
def staging_two_streams(spark, sf):
    """Two streams with checkpoints of their own fill one staging table: each has its batches, no row is overwritten."""
    path = scratch(spark)
    tables = Tables(spark, f"{path}/tables")
    for i, text in enumerate(_HALVES):
        measurement_files(spark, sf, f"{path}/in{i}", text=text)
        ingested(spark, tables, f"{path}/in{i}", f"{path}/checkpoint{i}")
    staged = tables.read("npdes_measurements", "staging").groupBy("etl_batch_id").agg(F.count(F.lit(1)).alias("rows"))
    return staged.select(F.when(F.col("etl_batch_id") == 1, "first").otherwise("second").alias("stream"), "rows")


@query("ingest_retry", f"SELECT 1 AS batches, CAST(2 AS BIGINT) AS log_events, count(*) AS staged, true AS findings_once FROM ({SQL['transform_measurements']}) AS t")
def ingest_retry(spark, sf):
    """A batch that is run again after it was staged and its findings stored leaves everything single."""
    path = scratch(spark)
    measurement_files(spark, sf, f"{path}/in")
    tables, wrote = Tables(spark, f"{path}/tables"), []

    class Lost(Tables):
        def put(self, df, name, part, schema="core"):
            super().put(df, name, part, schema)
            if name == "qa_findings":
                wrote.append(self.read(name).count())
                raise RuntimeError("lost after the findings were stored")

    try:
        ingested(spark, Lost(spark, tables.base), f"{path}/in", f"{path}/checkpoint")
    except StreamingQueryException:
        ingested(spark, tables, f"{path}/in", f"{path}/checkpoint")
    once = tables.read("qa_findings").agg((F.count(F.lit(1)) == F.lit(wrote[0])).alias("findings_once"))
    batches = tables.read("etl_run_log").agg(F.count_distinct("batch_id").cast("int").alias("batches"), F.count(F.lit(1)).alias("log_events"))
    staged = tables.read("npdes_measurements", "staging").agg(F.count(F.lit(1)).alias("staged"))
    return batches.select("*", staged.scalar().alias("staged"), once.scalar().alias("findings_once"))
