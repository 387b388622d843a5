"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "sievework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Adaptive execution re-plans joins and splits skewed partitions at run time.  On a cluster,
    ``spark.checkpoint.dir`` has to name a folder every executor can reach.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there.

    Used where a later step depends on how rows were laid out (a range partitioning, a row id) or
    where a loop would grow the plan.  The copy is a reliable one, so a lost executor costs a re-read
    and cannot change the layout.  A machine-local folder is chosen only in local mode.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            configured = tempfile.mkdtemp(prefix="sievework-checkpoint-")
        context.setCheckpointDir(configured)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """A copy of ``df`` as Parquet files in the checkpoint folder, spread over the tasks.

    For a frame that is scanned again and again: what makes its rows runs once, a scan reads only the columns it needs,
    and one big input file doesn't stay one task.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        settle(spark.range(1))
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
