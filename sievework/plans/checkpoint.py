"""QA runs: rules and detectors of a stage, findings, statistics, flags, and reports over many runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.scoring import share
from sievework.operators import detectors as rowwise
from sievework.functions.text import has_token
from sievework.operators import findings as finding
from sievework.operators import outliers, rulebook, rules, scores
from sievework.operators.anomalies import all_anomalies
from sievework.session import kept, settle


@dataclass(frozen=True)
class QaRun:
    results: DataFrame
    anomalies: DataFrame | None
    findings: DataFrame
    statistics: DataFrame


def run_stage(
    df: DataFrame, dataset: str, table: str, stage: str, as_of: datetime, tie: Sequence[str] = (),
    batch_id: int | None = None, extra_rules: Sequence[rules.Rule] = (),
) -> QaRun:
    """QA of one stage.

    extract: required fields and types.  transform: business and cross-field rules, outliers of all
    numeric columns that are no ids.  load: all rules and the compliance detectors.  Any other stage: everything.

    Results are kept as soon as they are computed (a row per check), so that findings, statistics,
    gate and reports made from them do not scan the data again.
    """
    label = f"{dataset}_{stage.lower()}" if stage.lower() in ("extract", "transform", "load") else dataset
    everything = stage.lower() not in ("extract", "transform", "load")
    if everything:  # rules and detectors scan it a dozen times
        df = kept(df)
    book = [*rulebook.stage_rules(df.schema, table, stage, as_of), *extra_rules]
    results = settle(rules.evaluate(df, book)) if book else None
    anomalies = None
    if stage.lower() == "transform":
        numeric = [c for c in scores.numeric_columns(df) if not has_token(c, "id")]
        if numeric:
            anomalies = outliers.outlier_summary(df, outliers.outlier_tests(df, numeric), numeric)
    elif stage.lower() == "load":
        checks = rowwise.compliance_detectors(df.columns)
        anomalies = rowwise.summarise(df, checks) if checks else None
    elif everything:
        anomalies = all_anomalies(df, tie, keep=False)
    if anomalies is not None:
        anomalies = settle(anomalies)
    listed = [finding.rule_findings(results, label, as_of, batch_id)] if results is not None else []
    if anomalies is not None:
        listed.append(finding.anomaly_findings(anomalies, label, as_of, batch_id))
    if not listed:
        raise ValueError(f"no checks for stage {stage} of {dataset}")
    found = listed[0] if len(listed) == 1 else listed[0].unionByName(listed[1])
    return QaRun(results, anomalies, found, finding.statistics(label, results, anomalies))


def comprehensive(df: DataFrame, dataset: str, table: str, as_of: datetime, tie: Sequence[str], batch_id: int | None = None) -> QaRun:
    return run_stage(df, dataset, table, "all", as_of, tie, batch_id)


def checkpoint(run: QaRun, quality: DataFrame | None, checkpoint_id: str, stage: str, as_of: datetime) -> DataFrame:
    """One row per checkpoint: statistics, score, flags and the decision to go on."""
    row = run.statistics
    # One subquery for all scores, so that the data is scored once.
    measured = quality.select(F.struct("overall_quality_score", "completeness_score", "accuracy_score", "consistency_score")).scalar() if quality is not None else None
    total = measured["overall_quality_score"] if measured is not None else F.lit(None).cast("double")
    stats = F.struct("overall_status", "critical_errors", "anomalies_found")
    return row.select(
        F.lit(checkpoint_id).alias("checkpoint_id"), F.lit(stage).alias("stage"), F.lit(as_of).alias("checked_at"), "*",
        total.alias("overall_quality_score"), finding.quality_flag_list(stats, measured).alias("quality_flags"),
    )


def checkpoint_report(checkpoints: DataFrame) -> DataFrame:
    """Pass rate, mean score and number of flags over checkpoints."""
    rows = F.count(F.lit(1))
    return checkpoints.agg(
        rows.alias("total_checkpoints"), F.count_if("may_continue").alias("passed_checkpoints"),
        share(F.count_if("may_continue"), rows).alias("success_rate"), F.sum("records_processed").alias("total_records"),
        F.coalesce(F.avg("overall_quality_score"), F.lit(0.0)).alias("average_quality_score"),
        F.sum(F.size("quality_flags")).alias("total_quality_issues"),
    )


def flag_counts(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("flag_count"))


def checkpoint_improvement(before: DataFrame, after: DataFrame, target: float = 42.0) -> DataFrame:
    """Two checkpoint reports compared: score and success gain, error reduction."""
    old = before.select(F.struct("average_quality_score", "success_rate")).scalar()
    failures_before = 100.0 - old["success_rate"]
    cut = F.when(failures_before > 0, (F.col("success_rate") - old["success_rate"]) / failures_before * 100.0).otherwise(0.0)
    return after.select(
        (F.col("average_quality_score") - old["average_quality_score"]).alias("quality_score_improvement"),
        (F.col("success_rate") - old["success_rate"]).alias("success_rate_improvement"),
        cut.alias("error_reduction_percentage"), (cut >= target).alias("target_met"),
    )


def performance(statistics: DataFrame) -> DataFrame:
    """Over many QA runs: datasets, records, time, rates, mean score and error rate, outcomes.

    Expects a ``processing_seconds`` column beside the statistics.
    """
    rows = F.count(F.lit(1))
    checks = F.sum(F.col("validation_checks") + F.col("anomaly_checks"))
    seconds = F.sum("processing_seconds")
    good = F.count_if(F.col("overall_status").isin("PASSED", "WARNING"))
    return statistics.agg(
        rows.alias("total_datasets"), F.sum("records_processed").alias("total_records"), seconds.alias("total_seconds"),
        F.coalesce(F.try_divide(F.sum("records_processed"), seconds), F.lit(0.0)).alias("records_per_second"),
        checks.alias("total_checks"), F.coalesce(F.try_divide(checks, seconds), F.lit(0.0)).alias("checks_per_second"),
        F.avg("quality_score").alias("average_quality_score"), F.avg("error_rate").alias("average_error_rate"),
        F.count_if(F.col("overall_status") == "PASSED").alias("datasets_passed"),
        F.count_if(F.col("overall_status") == "WARNING").alias("datasets_with_warnings"),
        F.count_if(F.col("overall_status") == "FAILED").alias("datasets_failed"),
        share(good, rows).alias("overall_success_rate"),
    )
