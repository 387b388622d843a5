"""Reports as frames: executive summary, issues, advice, facility analysis, alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scoring import fixed_point, score_band, share
from sievework.operators.ordering import dense_positions

SCORE_ALERT_BELOW = 70.0
ANOMALY_ALERT_ABOVE = 100
SCORE_TARGET = 80.0
PASS_RATE_TARGET = 95.0


def status_word(score: Column, critical: Column) -> Column:
    return (
        F.when(critical > 0, "CRITICAL ISSUES DETECTED").when(score >= 90, "EXCELLENT").when(score >= 80, "GOOD")
        .when(score >= 70, "ACCEPTABLE").otherwise("NEEDS IMPROVEMENT")
    )


def executive_summary(performance: DataFrame, validation: DataFrame, anomalies: DataFrame, as_of: datetime, reduction: DataFrame | None = None) -> DataFrame:
    """One row from the performance, validation and anomaly summaries.

    The error reduction is the measured one (``error_reduction_percentage`` of a comparison), or null
    without a baseline.
    """
    checks = validation.select(F.struct("total_checks", "overall_pass_rate", "critical_count")).scalar()
    found = anomalies.select(F.struct("anomalies_found", "detectors_with_anomalies")).scalar()
    measured = reduction.agg(F.avg("error_reduction_percentage")).scalar() if reduction is not None else F.lit(None).cast("double")
    return performance.select(
        F.lit(as_of).alias("report_date"), "total_datasets", "total_records", "average_quality_score", "records_per_second",
        status_word(F.col("average_quality_score"), checks["critical_count"]).alias("overall_status"),
        checks["total_checks"].alias("validation_checks"), checks["overall_pass_rate"].alias("validation_pass_rate"),
        checks["critical_count"].alias("critical_issues"), found["anomalies_found"].alias("anomalies_detected"),
        measured.alias("error_reduction_achieved"),
    )


def critical_issues(validation: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Issue rows: critical rule failures, and detectors with a severity above 0.8."""
    strict = validation.filter("critical_count > 0").select(
        F.lit("CRITICAL_VALIDATION_ERRORS").alias("issue_type"), F.col("critical_count").alias("issue_count"),
        F.lit("HIGH").alias("priority"), F.concat(F.col("critical_count").cast("string"), F.lit(" records break critical rules")).alias("description"),
        F.lit("Correct these records, or hold the load back until they are").alias("recommended_action"),
    )
    severe = anomalies.agg(F.count_if(F.col("severity_score") > 0.8).alias("n")).filter("n > 0").select(
        F.lit("HIGH_SEVERITY_ANOMALIES").alias("issue_type"), F.col("n").alias("issue_count"), F.lit("MEDIUM").alias("priority"),
        F.concat(F.col("n").cast("string"), F.lit(" detectors report a severity above 0.8")).alias("description"),
        F.lit("Look at the flagged rows and at the extract they came from").alias("recommended_action"),
    )
    return strict.unionByName(severe)


def recommendations(performance: DataFrame, validation: DataFrame) -> DataFrame:
    """Advice rows: score below 80, pass rate below 95."""
    score = performance.filter(F.col("average_quality_score") < SCORE_TARGET).select(
        F.lit("DATA_QUALITY").alias("category"), F.lit("HIGH").alias("priority"), F.lit("Raise the average quality score").alias("title"),
        F.concat(F.lit("The average score is "), fixed_point(F.col("average_quality_score")), F.lit(", under the aim of 80")).alias("description"),
        F.array(
            F.lit("Start with the rules that most rows break"), F.lit("Add cleaning steps for the columns these rules look at"),
            F.lit("Follow the score of every load over time"),
        ).alias("actions"),
    )
    passed = validation.filter(F.col("overall_pass_rate") < PASS_RATE_TARGET).select(
        F.lit("VALIDATION").alias("category"), F.lit("MEDIUM").alias("priority"), F.lit("Let more rules pass").alias("title"),
        F.lit("Fewer than 95 of 100 rules pass").alias("description"),
        F.array(
            F.lit("Find out which rules fail in every load"), F.lit("Adapt limits that valid rows exceed"),
            F.lit("Add rules for defects that users report"),
        ).alias("actions"),
    )
    return score.unionByName(passed)


def alerts(performance: DataFrame, validation: DataFrame, anomalies: DataFrame, as_of: datetime) -> DataFrame:
    """Alert rows: score below 70, any critical error, more than 100 anomalies."""
    low = performance.filter(F.col("average_quality_score") < SCORE_ALERT_BELOW).select(
        F.lit("QUALITY_SCORE_LOW").alias("alert_type"), F.lit("WARNING").alias("severity"),
        F.concat(F.lit("The average score is "), fixed_point(F.col("average_quality_score")), F.lit(", under the limit of 70")).alias("message"),
        F.lit("Work through the findings of the newest run").alias("recommended_action"),
    )
    critical = validation.filter("critical_count > 0").select(
        F.lit("CRITICAL_ERRORS").alias("alert_type"), F.lit("CRITICAL").alias("severity"),
        F.concat(F.col("critical_count").cast("string"), F.lit(" records break critical rules")).alias("message"),
        F.lit("Stop the load and look at the failing records").alias("recommended_action"),
    )
    many = anomalies.filter(F.col("anomalies_found") > ANOMALY_ALERT_ABOVE).select(
        F.lit("HIGH_ANOMALY_COUNT").alias("alert_type"), F.lit("WARNING").alias("severity"),
        F.concat(F.col("anomalies_found").cast("string"), F.lit(" anomalies, more than the 100 allowed")).alias("message"),
        F.lit("Compare the anomalies by type with earlier runs").alias("recommended_action"),
    )
    return low.unionByName(critical).unionByName(many).withColumn("ts", F.lit(as_of))


def rules_by_severity(results: DataFrame) -> DataFrame:
    return results.groupBy("severity").agg(
        F.count(F.lit(1)).alias("rule_count"), F.array_join(F.sort_array(F.collect_list("rule_name")), ",").alias("rules")
    )


def dataset_breakdown(statistics: DataFrame) -> DataFrame:
    """Datasets per score band with the mean score and how many reach 80."""
    return statistics.groupBy(score_band(F.col("quality_score")).alias("band")).agg(
        F.count(F.lit(1)).alias("datasets"), F.avg("quality_score").alias("average_quality_score"),
        F.count_if(F.col("quality_score") >= SCORE_TARGET).alias("datasets_above_threshold"),
    )


def facility_ranking(df: DataFrame, facility: str, score: str) -> DataFrame:
    """Facilities by mean score, best first, equal scores share a rank.

    The rank is global but is computed on distinct scores: facilities and scores are aggregated first,
    scores are numbered by range, and the ranks are joined back.
    """
    means = df.groupBy(facility).agg(F.round(F.avg(score), 6).alias("mean_score"), F.count(F.lit(1)).alias("records"))
    levels = means.select((-F.col("mean_score")).alias("_level")).distinct()
    ranks = dense_positions(levels, ["_level"]).select((-F.col("_level")).alias("mean_score"), (F.col("position") + 1).alias("quality_rank"))
    return means.join(ranks, "mean_score").select(facility, "mean_score", "records", "quality_rank")


def geographic_pattern(df: DataFrame, place: list[str], score: str) -> DataFrame:
    return df.groupBy(*place).agg(
        F.count(F.lit(1)).alias("records"), F.avg(score).alias("average_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score")
    )


def compliance_pattern(df: DataFrame, by: list[str], violations: str, inspections: str) -> DataFrame:
    """Violations, inspections and violations per inspection."""
    return df.groupBy(*by).agg(
        F.sum(violations).alias("violations"), F.sum(inspections).alias("inspections"),
        F.try_divide(F.sum(violations), F.sum(inspections)).alias("violations_per_inspection"),
        share(F.count_if(F.col(violations) > 0), F.count(F.lit(1))).alias("violating_share"),
    )


def score_distribution(df: DataFrame, score: str) -> DataFrame:
    return df.groupBy(score_band(F.col(score)).alias("band")).agg(F.count(F.lit(1)).alias("records"))
