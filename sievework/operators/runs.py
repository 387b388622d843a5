"""Analytics over run, task and alert events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.scoring import percent_change, share

TARGET_SPEEDUP = 37.0
RECENT_RUNS = 5
TREND_RUNS = 20
HIGH_BREACH = 1.5


def performance_report(runs: DataFrame) -> DataFrame:
    """Per process: executions, duration min/mean/max, throughput mean/peak, memory and CPU."""
    fast = F.when(F.col("records_per_second") > 0, F.col("records_per_second"))
    return runs.groupBy("process_name").agg(
        F.count(F.lit(1)).alias("total_executions"),
        F.avg("duration_seconds").alias("average_duration"),
        F.min("duration_seconds").alias("min_duration"),
        F.max("duration_seconds").alias("max_duration"),
        F.coalesce(F.avg(fast), F.lit(0.0)).alias("average_throughput"),
        F.coalesce(F.max(fast), F.lit(0.0)).alias("peak_throughput"),
        F.avg("average_memory_mb").alias("average_memory_mb"),
        F.max("average_memory_mb").alias("peak_memory_mb"),
        F.avg("average_cpu_percent").alias("average_cpu_percent"),
    )


def compare(baseline: DataFrame, candidate: DataFrame, key: str = "process_name") -> DataFrame:
    """Improvement of a candidate over its baseline in percent: time, throughput, memory, CPU."""
    joined = baseline.alias("b").join(candidate.alias("c"), key)
    less = lambda name: -percent_change(F.col(f"b.{name}"), F.col(f"c.{name}"))
    faster = less("duration_seconds")
    return joined.select(
        key,
        faster.alias("time_improvement"),
        F.coalesce(F.try_divide(F.col("b.duration_seconds"), F.col("c.duration_seconds")), F.lit(0.0)).alias("speed_multiplier"),
        (F.col("b.duration_seconds") - F.col("c.duration_seconds")).alias("time_saved_seconds"),
        percent_change(F.col("b.records_per_second"), F.col("c.records_per_second")).alias("throughput_improvement"),
        less("average_memory_mb").alias("memory_improvement"),
        less("average_cpu_percent").alias("cpu_improvement"),
        (faster >= TARGET_SPEEDUP).alias("target_met"),
    )


def recent_trend(runs: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Last 5 runs against the 15 before them: change of mean duration and throughput in percent.

    Only the last 20 runs per group leave a task.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(tie).desc())
    ranked = runs.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= TREND_RUNS)
    out = []
    for metric, label in (("duration_seconds", "duration_trend_percent"), ("records_per_second", "throughput_trend_percent")):
        # Runs without the metric do not take one of the five recent places.
        value = F.when(F.col(metric) != 0, F.col(metric))
        place = F.count(value).over(Window.partitionBy(*keys).orderBy("_age"))
        split = ranked.withColumns({"_value": value, "_place": place})
        banded = split.groupBy(*keys).agg(
            F.avg(F.when(F.col("_place") <= RECENT_RUNS, F.col("_value"))).alias("_recent"),
            F.avg(F.when(F.col("_place") > RECENT_RUNS, F.col("_value"))).alias("_older"),
        )
        out.append(banded.select(*keys, F.when(F.col("_older") > 0, (F.col("_recent") - F.col("_older")) / F.col("_older") * 100.0).alias(label)))
    return out[0].join(out[1], keys)


@dataclass(frozen=True)
class Sla:
    name: str
    metric: str
    operator: str
    threshold: float
    window_minutes: int = 60
    tolerated_breaches: int = 1


# The default agreements.
DEFAULT_SLAS = (
    Sla("workflow_duration", "duration", "<", 3600.0),
    Sla("task_failure_rate", "error_rate", "<", 5.0),
    Sla("memory_usage", "resource", "<", 85.0, window_minutes=15),
)


def meets(value: Column, operator: str, threshold: Column) -> Column:
    return {
        "<": value < threshold, "<=": value <= threshold, ">": value > threshold, ">=": value >= threshold,
        "==": value == threshold, "!=": value != threshold,
    }[operator]


def sla_checks(metrics: DataFrame, slas: tuple[Sla, ...] = DEFAULT_SLAS) -> DataFrame:
    """Every metric event (metric_name, metric_value, ts) judged; metrics without an SLA comply."""
    name, value = F.col("metric_name"), F.col("metric_value")
    ok, limit = F.lit(True), F.lit(None).cast("double")
    for sla in slas:
        ok = F.when(name == sla.name, meets(value, sla.operator, F.lit(sla.threshold))).otherwise(ok)
        limit = F.when(name == sla.name, F.lit(sla.threshold)).otherwise(limit)
    severity = F.when(~ok, F.when(value > limit * HIGH_BREACH, "HIGH").otherwise("MEDIUM"))
    return metrics.withColumns({"threshold_value": limit, "compliant": ok, "breach_severity": severity})


def sla_report(checks: DataFrame) -> DataFrame:
    """Per agreement: checks, violations, high violations, and measured compliance in percent."""
    violations = F.count_if(~F.col("compliant"))
    return checks.filter("threshold_value is not null").groupBy("metric_name").agg(
        F.count(F.lit(1)).alias("checks"),
        violations.alias("violations"),
        F.count_if(F.col("breach_severity") == "HIGH").alias("high_violations"),
        (100.0 - share(violations, F.count(F.lit(1)))).alias("compliance_rate"),
    )


def compliance_estimate(total_violations: Column, total_slas: Column) -> Column:
    """100 less ten points per violation and agreement, never below 0."""
    return F.greatest(F.lit(0.0), 100.0 - total_violations / F.greatest(total_slas, F.lit(1)) * 10.0)


def sla_alerts(checks: DataFrame) -> DataFrame:
    """An alert per violation: CRITICAL for high ones, WARNING for the rest."""
    severity = F.when(F.col("breach_severity") == "HIGH", "CRITICAL").otherwise("WARNING")
    return checks.filter(~F.col("compliant")).select(
        F.concat(F.lit("SLA Breach: "), "metric_name").alias("title"), severity.alias("severity"),
        F.lit("SLA_BREACH").alias("alert_type"), "metric_value", "threshold_value", "ts",
    )


def latest_alerts(events: DataFrame) -> DataFrame:
    """Current state of every alert from its events (created, acknowledged, resolved)."""
    return events.groupBy("alert_id").agg(
        F.min_by("severity", "ts").alias("severity"), F.min_by("alert_type", "ts").alias("alert_type"),
        F.max("acknowledged").alias("acknowledged"), F.max("resolved").alias("resolved"), F.min("ts").alias("created_at"),
    )


def alert_statistics(alerts: DataFrame) -> DataFrame:
    """Counts per severity and type: all, active, acknowledged."""
    return alerts.groupBy("severity", "alert_type").agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(~F.col("resolved")).alias("active_alerts"),
        F.count_if(F.col("acknowledged")).alias("acknowledged_alerts"),
    )


def health_score(
    alerts: DataFrame, compliance: Column | float, memory_percent: Column | float = 0.0, cpu_percent: Column | float = 0.0, keys: list[str] | None = None
) -> DataFrame:
    """100 less 10 per active critical and 20 per active emergency alert, half of the missing SLA
    compliance, twice the memory and once the CPU percentage above 85; between 0 and 100.  One row, or one for
    each value of ``keys``."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    active = lambda level: F.count_if((F.col("severity") == level) & ~F.col("resolved"))
    excess = lambda v: F.greatest(F.lit(0.0), as_column(v) - 85.0)
    counted = alerts.groupBy(*(keys or [])).agg(active("CRITICAL").alias("active_critical"), active("EMERGENCY").alias("active_emergency"))
    score = 100.0 - F.col("active_critical") * 10 - F.col("active_emergency") * 20 - (100.0 - as_column(compliance)) * 0.5 - excess(memory_percent) * 2 - excess(cpu_percent)
    return counted.withColumn("health_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def task_rollup(tasks: DataFrame, run: str = "run_id") -> DataFrame:
    """Tasks per run and its outcome: SUCCESS, PARTIAL_SUCCESS or FAILED."""
    counted = tasks.groupBy(run).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(F.col("status") == "SUCCESS").alias("completed_tasks"),
        F.count_if(F.col("status") == "FAILED").alias("failed_tasks"),
        F.sum("duration_seconds").alias("total_duration"),
    )
    outcome = F.when(F.col("failed_tasks") == 0, "SUCCESS").when(F.col("completed_tasks") > 0, "PARTIAL_SUCCESS").otherwise("FAILED")
    return counted.withColumn("final_status", outcome)


def rollup_totals(rollup: DataFrame) -> DataFrame:
    return rollup.agg(
        F.count(F.lit(1)).alias("workflows"), F.sum("total_tasks").alias("tasks"), F.sum("completed_tasks").alias("successful_tasks"),
        F.sum("failed_tasks").alias("failed_tasks"), F.avg("total_duration").alias("average_duration"),
    )


def dashboard(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Executed and failed counts and the mean duration of the successful ones.

    ``COMPLETED`` and ``SUCCESS`` both count as executed.
    """
    done = F.col("status").isin("COMPLETED", "SUCCESS")
    return events.groupBy(*(keys or [])).agg(
        F.count_if(done).alias("executed"), F.count_if(F.col("status") == "FAILED").alias("failures"),
        F.avg(F.when(done, F.col("duration_seconds"))).alias("average_duration"),
        F.count_if(F.col("status").isin("RUNNING", "PENDING")).alias("active"),
    )


def recent_alerts(alerts: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Counts of the alerts of the last hours."""
    fresh = alerts.filter(F.col("ts") > F.lit(as_of - timedelta(hours=hours)))
    return fresh.agg(
        F.count(F.lit(1)).alias("total_alerts"), F.count_if(F.col("severity") == "CRITICAL").alias("critical_alerts"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_alerts"),
    )
