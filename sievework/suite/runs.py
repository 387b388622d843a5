"""Run-log, task, alert and service-level analytics over the event table as a run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import runs
from sievework.sources import runlog
from sievework.streaming import windows
from sievework.suite.frames import RUNS, cte
from sievework.suite.registry import AS_OF, frame, query, rounded


@query(
    "run_report",
    cte(r=RUNS)
    + """SELECT process_name, count(*) AS total_executions, round(avg(duration_seconds), 6) AS average_duration, min(duration_seconds) AS min_duration, max(duration_seconds) AS max_duration,
      round(coalesce(avg(records_per_second) FILTER (WHERE records_per_second > 0), 0), 6) AS average_throughput, round(coalesce(max(records_per_second) FILTER (WHERE records_per_second > 0), 0), 6) AS peak_throughput,
      round(avg(average_memory_mb), 6) AS average_memory_mb, round(max(average_memory_mb), 6) AS peak_memory_mb, round(avg(average_cpu_percent), 6) AS average_cpu_percent FROM r GROUP BY process_name""",
)
def run_report(spark, sf):
    return rounded(runs.performance_report(frame(spark, sf, RUNS)))


def mean_runs(condition: str) -> str:
    return f"""SELECT process_name, avg(duration_seconds) AS duration_seconds, avg(records_per_second) AS records_per_second, avg(average_memory_mb) AS average_memory_mb,
      avg(average_cpu_percent) AS average_cpu_percent FROM ({RUNS}) AS r WHERE {condition} GROUP BY process_name"""


_OLD, _NEW = mean_runs("user_id <= 75"), mean_runs("user_id > 75")


@query(
    "run_comparison",
    cte(b=_OLD, c=_NEW)
    + """SELECT b.process_name, round((b.duration_seconds - c.duration_seconds) / b.duration_seconds * 100, 6) AS time_improvement, round(b.duration_seconds / c.duration_seconds, 6) AS speed_multiplier,
      round(b.duration_seconds - c.duration_seconds, 6) AS time_saved_seconds, round((c.records_per_second - b.records_per_second) / b.records_per_second * 100, 6) AS throughput_improvement,
      round((b.average_memory_mb - c.average_memory_mb) / b.average_memory_mb * 100, 6) AS memory_improvement, round((b.average_cpu_percent - c.average_cpu_percent) / b.average_cpu_percent * 100, 6) AS cpu_improvement,
      (b.duration_seconds - c.duration_seconds) / b.duration_seconds * 100 >= 37 AS target_met FROM b JOIN c ON b.process_name = c.process_name""",
)
def run_comparison(spark, sf):
    """Mean runs of one half of the users against the other."""
    return rounded(runs.compare(frame(spark, sf, _OLD), frame(spark, sf, _NEW)))


def _change(metric: str, label: str) -> str:
    return f"""(SELECT process_name, CASE WHEN avg(v) FILTER (WHERE place > 5) > 0 THEN round((avg(v) FILTER (WHERE place <= 5) - avg(v) FILTER (WHERE place > 5)) / avg(v) FILTER (WHERE place > 5) * 100, 6) END AS {label}
      FROM (SELECT process_name, {metric} AS v, row_number() OVER (PARTITION BY process_name ORDER BY age) AS place FROM k WHERE {metric} <> 0) AS x GROUP BY process_name)"""


@query(
    "recent_trend",
    cte(r=RUNS)
    + ", k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY process_name ORDER BY ts DESC, batch_id DESC) AS age FROM r) AS o WHERE age <= 20) "
    + f"SELECT d.process_name, duration_trend_percent, throughput_trend_percent FROM {_change('duration_seconds', 'duration_trend_percent')} AS d JOIN {_change('records_per_second', 'throughput_trend_percent')} AS t ON t.process_name = d.process_name",
)
def recent_trend(spark, sf):
    return rounded(runs.recent_trend(frame(spark, sf, RUNS), ["process_name"], "ts", "batch_id"))


# Measurements of three agreed metrics and of one nobody agreed on.
METRICS = """
SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'task_failure_rate' WHEN 'purchase' THEN 'memory_usage' WHEN 'view' THEN 'workflow_duration' ELSE 'other' END AS metric_name,
       CASE event_type WHEN 'error' THEN value / 20e0 WHEN 'view' THEN value * 40e0 ELSE value END AS metric_value
FROM events
"""
_LIMIT = "CASE metric_name WHEN 'workflow_duration' THEN 3600e0 WHEN 'task_failure_rate' THEN 5e0 WHEN 'memory_usage' THEN 85e0 END"
_JUDGED = f"SELECT *, {_LIMIT} AS threshold_value, coalesce(metric_value < {_LIMIT}, true) AS compliant FROM ({METRICS}) AS m"
_BREACHES = f"SELECT *, CASE WHEN NOT compliant THEN CASE WHEN metric_value > threshold_value * 1.5e0 THEN 'HIGH' ELSE 'MEDIUM' END END AS breach_severity FROM ({_JUDGED}) AS j"


def checked(spark, sf):
    return runs.sla_checks(frame(spark, sf, METRICS))


@query("sla_checks", f"SELECT event_id, metric_name, threshold_value, compliant, breach_severity FROM ({_BREACHES}) AS b")
def sla_checks(spark, sf):
    return checked(spark, sf).select("event_id", "metric_name", "threshold_value", "compliant", "breach_severity")


@query(
    "sla_report",
    f"""SELECT metric_name, count(*) AS checks, count(*) FILTER (WHERE NOT compliant) AS violations, count(*) FILTER (WHERE breach_severity = 'HIGH') AS high_violations,
      round(100 - count(*) FILTER (WHERE NOT compliant) * 100e0 / count(*), 6) AS compliance_rate FROM ({_BREACHES}) AS b WHERE threshold_value IS NOT NULL GROUP BY metric_name""",
)
def sla_report(spark, sf):
    return rounded(runs.sla_report(checked(spark, sf)))


@query(
    "sla_compliance",
    f"""SELECT CAST(time_bucket(INTERVAL 60 MINUTES, ts) AS VARCHAR) AS hour, count(*) AS checks, round(greatest(0e0, 100 - count(*) FILTER (WHERE NOT compliant) / 3e0 * 10), 6) AS compliance
      FROM ({_JUDGED}) AS j GROUP BY 1""",
)
def sla_compliance(spark, sf):
    """The published estimate, ten points per violation and agreement, for every hour: over all hours it is 0."""
    hours = checked(spark, sf).groupBy(F.date_trunc("hour", "ts").cast("string").alias("hour"))
    estimate = runs.compliance_estimate(F.count_if(~F.col("compliant")), F.lit(len(runs.DEFAULT_SLAS)))
    return rounded(hours.agg(F.count(F.lit(1)).alias("checks"), estimate.alias("compliance")))


@query(
    "sla_alerts",
    f"SELECT title, severity, count(*) AS alerts, round(sum(metric_value), 4) AS total_value FROM (SELECT 'SLA Breach: ' || metric_name AS title, CASE breach_severity WHEN 'HIGH' THEN 'CRITICAL' ELSE 'WARNING' END AS severity, metric_value FROM ({_BREACHES}) AS b WHERE NOT compliant) AS a GROUP BY ALL",
)
def sla_alerts(spark, sf):
    raised = runs.sla_alerts(checked(spark, sf))
    return rounded(raised.groupBy("title", "severity").agg(F.count(F.lit(1)).alias("alerts"), F.sum("metric_value").alias("total_value")), 4)


def windows_sql(where: str, minutes: int) -> str:
    return f"""SELECT CAST(time_bucket(INTERVAL {minutes} MINUTES, ts) AS VARCHAR) AS window_start, metric_name, count(*) AS checks, count(*) FILTER (WHERE NOT compliant) AS breaches,
      round(max(metric_value), 6) AS worst_value, count(*) FILTER (WHERE NOT compliant) >= 1 AS alert FROM ({_JUDGED}) AS j WHERE {where} GROUP BY 1, 2"""


SLA_WINDOWS = windows_sql("metric_name IN ('workflow_duration', 'task_failure_rate')", 60) + " UNION ALL " + windows_sql("metric_name = 'memory_usage'", 15)


@query("sla_windows", SLA_WINDOWS)
def sla_windows(spark, sf):
    counted = windows.sla_windows(frame(spark, sf, METRICS))
    return rounded(counted.withColumn("window_start", F.col("window_start").cast("string")).drop("window_end"))


DASHBOARD = cte(r=RUNS) + """SELECT CAST(time_bucket(INTERVAL 60 MINUTES, ts) AS VARCHAR) AS window_start, process_name, count(*) FILTER (WHERE status = 'SUCCESS') AS executed,
    count(*) FILTER (WHERE status = 'FAILED') AS failures, round(avg(duration_seconds) FILTER (WHERE status = 'SUCCESS'), 6) AS average_duration FROM r GROUP BY 1, 2"""


@query("dashboard_windows", DASHBOARD)
def dashboard_windows(spark, sf):
    counted = windows.dashboard_windows(frame(spark, sf, RUNS), 60, ("process_name",))
    return rounded(counted.withColumn("window_start", F.col("window_start").cast("string")))


@query(
    "dashboard",
    cte(r=RUNS)
    + """SELECT process_name, count(*) FILTER (WHERE status = 'SUCCESS') AS executed, count(*) FILTER (WHERE status = 'FAILED') AS failures,
      round(avg(duration_seconds) FILTER (WHERE status = 'SUCCESS'), 6) AS average_duration, count(*) FILTER (WHERE status = 'RUNNING') AS active FROM r GROUP BY process_name""",
)
def dashboard(spark, sf):
    return rounded(runs.dashboard(frame(spark, sf, RUNS), ["process_name"]))


# Every user stands for an alert; the events are its history.
ALERT_EVENTS = """
SELECT user_id AS alert_id, ts, CASE WHEN value > 100 THEN 'EMERGENCY' WHEN value > 50 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
       CASE event_type WHEN 'error' THEN 'TASK_FAILURE' WHEN 'view' THEN 'SLA_BREACH' ELSE 'DATA_QUALITY' END AS alert_type,
       event_type = 'click' AND value > 150 AS acknowledged, event_type = 'purchase' AND value > 170 AS resolved
FROM events
"""
_LATEST = f"""SELECT alert_id, min_by(severity, ts) AS severity, min_by(alert_type, ts) AS alert_type, max(CAST(acknowledged AS INT)) = 1 AS acknowledged, max(CAST(resolved AS INT)) = 1 AS resolved, min(ts) AS created_at
    FROM ({ALERT_EVENTS}) AS e GROUP BY alert_id"""


def alerts_of(spark, sf):
    return runs.latest_alerts(frame(spark, sf, ALERT_EVENTS))


@query("latest_alerts", f"SELECT alert_id, severity, alert_type, acknowledged, resolved, CAST(created_at AS VARCHAR) AS created_at FROM ({_LATEST}) AS l")
def latest_alerts(spark, sf):
    return alerts_of(spark, sf).withColumn("created_at", F.col("created_at").cast("string"))


@query(
    "alert_statistics",
    f"SELECT severity, alert_type, count(*) AS total_alerts, count(*) FILTER (WHERE NOT resolved) AS active_alerts, count(*) FILTER (WHERE acknowledged) AS acknowledged_alerts FROM ({_LATEST}) AS l GROUP BY ALL",
)
def alert_statistics(spark, sf):
    return runs.alert_statistics(alerts_of(spark, sf))


@query(
    "health_score",
    f"""SELECT hour, active_critical, active_emergency, round(greatest(0e0, least(100e0, 100 - active_critical * 10 - active_emergency * 20 - 2.5e0 - 4e0 - 5e0)), 6) AS health_score
      FROM (SELECT CAST(time_bucket(INTERVAL 60 MINUTES, created_at) AS VARCHAR) AS hour, count(*) FILTER (WHERE severity = 'CRITICAL' AND NOT resolved) AS active_critical,
        count(*) FILTER (WHERE severity = 'EMERGENCY' AND NOT resolved) AS active_emergency FROM ({_LATEST}) AS l GROUP BY 1) AS c""",
)
def health_score(spark, sf):
    """SLA compliance 95, memory 87 %, CPU 90 %; for the alerts of every hour, since over all of them it is 0."""
    alerts = alerts_of(spark, sf).withColumn("hour", F.date_trunc("hour", "created_at").cast("string"))
    return rounded(runs.health_score(alerts, 95.0, 87.0, 90.0, keys=["hour"]))


@query(
    "recent_alerts",
    f"""SELECT count(*) AS total_alerts, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_alerts, count(*) FILTER (WHERE severity = 'WARNING') AS warning_alerts
      FROM ({ALERT_EVENTS}) AS e WHERE ts > TIMESTAMP '2024-01-30 00:00:00'""",
)
def recent_alerts(spark, sf):
    return runs.recent_alerts(frame(spark, sf, ALERT_EVENTS), AS_OF)


TASKS = "SELECT user_id AS run_id, event_id, CASE WHEN event_type = 'error' AND value > 60 THEN 'FAILED' WHEN value > 1 THEN 'SUCCESS' ELSE 'SKIPPED' END AS status, value AS duration_seconds FROM events"
_ROLLUP = f"""SELECT run_id, total_tasks, completed_tasks, failed_tasks, total_duration, CASE WHEN failed_tasks = 0 THEN 'SUCCESS' WHEN completed_tasks > 0 THEN 'PARTIAL_SUCCESS' ELSE 'FAILED' END AS final_status
    FROM (SELECT run_id, count(*) AS total_tasks, count(*) FILTER (WHERE status = 'SUCCESS') AS completed_tasks, count(*) FILTER (WHERE status = 'FAILED') AS failed_tasks, sum(duration_seconds) AS total_duration FROM ({TASKS}) AS t GROUP BY run_id) AS c"""


@query("task_rollup", f"SELECT run_id, total_tasks, completed_tasks, failed_tasks, round(total_duration, 4) AS total_duration, final_status FROM ({_ROLLUP}) AS r")
def task_rollup(spark, sf):
    return rounded(runs.task_rollup(frame(spark, sf, TASKS)), 4)


@query(
    "task_totals",
    f"SELECT count(*) AS workflows, CAST(sum(total_tasks) AS BIGINT) AS tasks, CAST(sum(completed_tasks) AS BIGINT) AS successful_tasks, CAST(sum(failed_tasks) AS BIGINT) AS failed_tasks, round(avg(total_duration), 4) AS average_duration FROM ({_ROLLUP}) AS r",
)
def task_totals(spark, sf):
    return rounded(runs.rollup_totals(runs.task_rollup(frame(spark, sf, TASKS))), 4)


# Two log events per run: opened, and closed an hour later; a running batch has only the first.
LOG = f"""
SELECT batch_id, process_name, start_time, CAST(NULL AS TIMESTAMP) AS end_time, 'RUNNING' AS status, CAST(0 AS BIGINT) AS records_processed, start_time AS event_time FROM ({RUNS}) AS a
UNION ALL SELECT batch_id, NULL, NULL, start_time + INTERVAL 1 HOUR, status, records_processed, start_time + INTERVAL 1 HOUR FROM ({RUNS}) AS b WHERE status <> 'RUNNING'
"""


@query(
    "run_log",
    cte(r=RUNS)
    + """SELECT batch_id, process_name, status, CAST(start_time AS VARCHAR) AS start_time, CASE WHEN status <> 'RUNNING' THEN CAST(start_time + INTERVAL 1 HOUR AS VARCHAR) END AS end_time,
      CASE WHEN status <> 'RUNNING' THEN records_processed ELSE 0 END AS records_processed FROM r""",
)
def run_log(spark, sf):
    states = runlog.current_runs(frame(spark, sf, LOG))
    return states.withColumns({c: F.col(c).cast("string") for c in ("start_time", "end_time")})


EXTRACTIONS = """SELECT event_type AS source, l.start_time, l.start_time + INTERVAL 90 SECONDS AS end_time, l.rows_read AS rows, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors, CASE WHEN value > 100 THEN 2 ELSE 0 END AS warnings
FROM (SELECT event_type, value, ts AS start_time, CAST(floor(value * 900e0) AS BIGINT) AS rows_read FROM events) AS l"""


@query(
    "extraction_summary",
    cte(x=EXTRACTIONS)
    + """SELECT source, CAST(sum(rows) AS BIGINT) AS total_rows, CAST(sum(errors) AS BIGINT) AS error_count, CAST(sum(warnings) AS BIGINT) AS warning_count, count(*) * 90e0 AS duration_seconds,
      round(sum(rows) / (count(*) * 90e0), 6) AS rows_per_second FROM x GROUP BY source""",
)
def extraction_summary(spark, sf):
    return rounded(runlog.extraction_summary(frame(spark, sf, EXTRACTIONS)))


@query("last_runs", cte(r=RUNS) + "SELECT batch_id, process_name, status FROM r ORDER BY ts DESC, batch_id DESC LIMIT 10")
def last_runs(spark, sf):
    return runlog.last_events(frame(spark, sf, RUNS), "ts", "batch_id").select("batch_id", "process_name", "status")


@query(
    "last_runs_per_process",
    cte(r=RUNS) + "SELECT batch_id, process_name, CAST(n AS INT) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY process_name ORDER BY ts DESC, batch_id DESC) AS n FROM r) AS k WHERE n <= 10",
)
def last_runs_per_process(spark, sf):
    return runlog.last_events_per(frame(spark, sf, RUNS), ["process_name"], "ts", "batch_id").select("batch_id", "process_name", "recency")
