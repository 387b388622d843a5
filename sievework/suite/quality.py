"""QA runs: findings, statistics, gates, checkpoints and the reports made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import anomalies, detectors, findings, rules
from sievework.plans import checkpoint, reports
from sievework.sources.tables import Tables
from sievework.suite.checks import EMISSION_CHECKS, FACILITY_CHECKS, PERMIT_CHECKS, results_of, rules_sql
from sievework.suite.frames import EMISSIONS, FACILITIES, PERMITS, cte
from sievework.suite.registry import AS_OF, SQL, frame, query, rounded, scratch, table

_EMISSION_RESULTS = cte(e=EMISSIONS) + rules_sql("e", EMISSION_CHECKS)
_FACILITY_RESULTS = cte(f=FACILITIES) + rules_sql("f", FACILITY_CHECKS)
_PERMIT_RESULTS = cte(p=PERMITS) + rules_sql("p", PERMIT_CHECKS)
_DETECTED = SQL["compliance_detectors"]

_TYPED = """CASE WHEN rule_name LIKE 'required%' THEN 'MISSING_VALUE' WHEN rule_name LIKE 'numeric_type%' OR rule_name LIKE 'date_type%' OR rule_name LIKE 'string_format%' OR rule_name = 'state_codes' THEN 'INVALID_FORMAT'
    WHEN rule_name IN ('permit_date_logic', 'coordinate_consistency', 'flow_consistency') THEN 'BUSINESS_RULE' ELSE 'OUT_OF_RANGE' END"""


def rule_findings_sql(label: str, results: str) -> str:
    return f"""SELECT '{label}' AS table_name, rule_name AS check_name, {_TYPED} AS finding_type,
      CASE severity WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'WARNING' THEN 'MEDIUM' ELSE 'LOW' END AS severity, failed_count AS affected_records FROM ({results}) AS r"""


def anomaly_findings_sql(label: str, results: str) -> str:
    return f"""SELECT '{label}' AS table_name, detector_name AS check_name, 'DATA_ANOMALY' AS finding_type,
      CASE WHEN severity_score > 0.8e0 THEN 'CRITICAL' WHEN severity_score > 0.4e0 THEN 'MEDIUM' ELSE 'LOW' END AS severity, anomaly_count AS affected_records
      FROM ({results}) AS a WHERE anomaly_count > 0"""


def shown(found):
    return found.select("table_name", F.substring_index("finding_description", ":", 1).alias("check_name"), "finding_type", "severity", "affected_records")


@query("rule_findings", rule_findings_sql("air_emissions", _EMISSION_RESULTS))
def rule_findings(spark, sf):
    return shown(findings.rule_findings(results_of(spark, sf, EMISSIONS, "air_emissions"), "air_emissions", AS_OF))


def detected(spark, sf):
    rows = frame(spark, sf, FACILITIES)
    return detectors.summarise(rows, detectors.compliance_detectors(rows.columns))


@query("anomaly_findings", anomaly_findings_sql("facilities", _DETECTED))
def anomaly_findings(spark, sf):
    return shown(findings.anomaly_findings(detected(spark, sf), "facilities", AS_OF))


def load_run(spark, sf):
    return checkpoint.run_stage(frame(spark, sf, FACILITIES), "facilities", "facilities", "load", AS_OF, batch_id=1)


_LOAD_FINDINGS = rule_findings_sql("facilities_load", _FACILITY_RESULTS) + " UNION ALL " + anomaly_findings_sql("facilities_load", _DETECTED)


@query("findings", _LOAD_FINDINGS)
def all_findings(spark, sf):
    """Rules and detectors of a load in one list."""
    return shown(load_run(spark, sf).findings)


@query("stored_findings", f"SELECT finding_type, severity, count(*) AS findings, CAST(sum(affected_records) AS BIGINT) AS affected_records FROM ({_LOAD_FINDINGS}) AS x GROUP BY ALL")
def stored_findings(spark, sf):
    tables = Tables(spark, scratch(spark))
    findings.store_findings(load_run(spark, sf).findings, tables)
    return tables.read("qa_findings").groupBy("finding_type", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.sum("affected_records").alias("affected_records")
    )


@query(
    "findings_with_samples",
    cte(p=PERMITS)
    + ", x AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS rule_name, permit_id, row_number() OVER (ORDER BY permit_id) AS k FROM p WHERE {c}" for n, _, c in PERMIT_CHECKS)
    + "), s AS (SELECT rule_name, string_agg(CAST(permit_id AS VARCHAR), ',' ORDER BY CAST(permit_id AS VARCHAR)) AS ids FROM x WHERE k <= 10 GROUP BY rule_name)"
    + f" SELECT r.rule_name AS check_name, failed_count AS affected_records, coalesce(ids, '') AS sample_values FROM ({_PERMIT_RESULTS}) AS r LEFT JOIN s ON r.rule_name = s.rule_name",
)
def findings_with_samples(spark, sf):
    from sievework.operators import rulebook

    rows = frame(spark, sf, PERMITS)
    book = rulebook.all_rules(rows.schema, "permits", AS_OF)
    found = findings.rule_findings(rules.evaluate(rows, book), "permits", AS_OF)
    listed = findings.with_samples(found, rules.sample_failures(rows, book, ["permit_id"]), "permit_id")
    return listed.select(
        F.substring_index("finding_description", ":", 1).alias("check_name"), "affected_records", F.array_join("sample_values", ",").alias("sample_values")
    )


def judged_sql(counts: str) -> str:
    """Rates, status and gate over rows of counts."""
    return f"""SELECT dataset_name, records_processed, validation_checks, anomaly_checks, critical_errors, warnings, anomalies_found,
      round(coalesce((critical_errors + warnings) * 100e0 / nullif(checks, 0), 0), 6) AS error_rate,
      round(greatest(0e0, 100 - coalesce((critical_errors + warnings) * 100e0 / nullif(checks, 0), 0)), 6) AS quality_score,
      CASE WHEN checks = 0 THEN 'ERROR' WHEN critical_errors * 100e0 / checks > 5 THEN 'FAILED' WHEN warnings * 100e0 / checks > 15 THEN 'WARNING' ELSE 'PASSED' END AS overall_status,
      checks > 0 AND critical_errors * 100e0 / checks <= 5 AS may_continue FROM (SELECT *, validation_checks + anomaly_checks AS checks FROM ({counts}) AS c) AS d"""


def counts_sql(label: str, results: str, anomaly_results: str | None = None) -> str:
    hits = f"(SELECT count(*) FROM ({anomaly_results}) AS a)" if anomaly_results else "0"
    found = f"(SELECT CAST(coalesce(sum(anomaly_count), 0) AS BIGINT) FROM ({anomaly_results}) AS a)" if anomaly_results else "0"
    return f"""SELECT '{label}' AS dataset_name, max(total_count) AS records_processed, count(*) AS validation_checks, CAST({hits} AS BIGINT) AS anomaly_checks,
      count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings, CAST({found} AS BIGINT) AS anomalies_found FROM ({results}) AS r"""


def checks_of(checks, groups: str):
    """Checks of a stage: required and type rules, or the business and cross-field ones."""
    first = ("required", "numeric_type", "date_type", "string_format")
    return [c for c in checks if c[0].startswith(first) == (groups == "extract")]


_EXTRACT = judged_sql(counts_sql("facilities_extract", cte(f=FACILITIES) + rules_sql("f", checks_of(FACILITY_CHECKS, "extract"))))
_TRANSFORM_OUTLIERS = cte(f=FACILITIES) + " UNION ALL ".join(
    f"""SELECT count(*) FILTER (WHERE abs((x - m) / d) > 3) AS anomaly_count FROM (SELECT {c} AS x, (SELECT avg({c}) FROM f) AS m, (SELECT stddev_pop({c}) FROM f) AS d FROM f) AS t
    UNION ALL SELECT count(*) FILTER (WHERE x < a - 1.5e0 * (b - a) OR x > b + 1.5e0 * (b - a)) FROM (SELECT {c} AS x, (SELECT quantile_cont({c}, 0.25) FROM f) AS a, (SELECT quantile_cont({c}, 0.75) FROM f) AS b FROM f) AS t
    UNION ALL SELECT count(*) FILTER (WHERE abs((x - m) * 0.6745e0 / d) > 3.5e0) FROM (SELECT {c} AS x, (SELECT median({c}) FROM f) AS m, (SELECT median(abs({c} - (SELECT median({c}) FROM f))) FROM f) AS d FROM f) AS t"""
    for c in (
        "latitude", "longitude", "epa_region", "annual_emission_amount", "ph_level", "measurement_year", "compliance_violations", "violation_count", "inspection_count",
        "penalty_amount", "data_quality_score",
    )
)
_TRANSFORM = judged_sql(counts_sql("facilities_transform", cte(f=FACILITIES) + rules_sql("f", checks_of(FACILITY_CHECKS, "transform")), _TRANSFORM_OUTLIERS))
_LOAD = judged_sql(counts_sql("facilities_load", _FACILITY_RESULTS, _DETECTED))


@query("stage_statistics", f"{_EXTRACT} UNION ALL {_TRANSFORM} UNION ALL {_LOAD}")
def stage_statistics(spark, sf):
    """The same table judged at its three stages."""
    rows = frame(spark, sf, FACILITIES)
    runs = [checkpoint.run_stage(rows, "facilities", "facilities", stage, AS_OF).statistics for stage in ("extract", "transform", "load")]
    return rounded(runs[0].unionByName(runs[1]).unionByName(runs[2]).drop("gate_message"))


@query(
    "qa_status",
    " UNION ALL ".join(
        judged_sql(counts_sql(label, results))
        for label, results in (("facilities", _FACILITY_RESULTS), ("permits", _PERMIT_RESULTS), ("air_emissions", _EMISSION_RESULTS))
    ),
)
def qa_status(spark, sf):
    frames = {"facilities": FACILITIES, "permits": PERMITS, "air_emissions": EMISSIONS}
    parts = [findings.statistics(name, results_of(spark, sf, text, name)) for name, text in frames.items()]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("gate_message"))


@query(
    "comprehensive_qa",
    f"""SELECT finding_type, severity, count(*) AS findings
      FROM ({rule_findings_sql("facilities", _FACILITY_RESULTS)} UNION ALL {anomaly_findings_sql("facilities", SQL["all_anomalies"])}) AS x GROUP BY finding_type, severity""",
)
def comprehensive_qa(spark, sf):
    """Every rule and every detector of one table, counted per severity."""
    run = checkpoint.comprehensive(frame(spark, sf, FACILITIES), "facilities", "facilities", AS_OF, ["facility_id"])
    return run.findings.groupBy("finding_type", "severity").agg(F.count(F.lit(1)).alias("findings"))


def qa_runs(critical: int, warning: int) -> str:
    """One QA run per user of the event table: counts of checks and of values above the limits."""
    return f"""SELECT 'user_' || CAST(user_id AS STRING) AS dataset_name, count(*) AS records_processed, CAST(20 AS BIGINT) AS validation_checks,
      count(CASE WHEN event_type = 'view' THEN 1 END) AS anomaly_checks, count(CASE WHEN value > {critical} THEN 1 END) AS critical_errors,
      count(CASE WHEN value > {warning} THEN 1 END) AS warnings, count(CASE WHEN value > 120 THEN 1 END) AS anomalies_found, sum(value) / 100e0 AS processing_seconds,
      100e0 - count(CASE WHEN value > 130 THEN 1 END) * 100e0 / count(*) AS completeness_score, 100e0 - count(CASE WHEN value > 140 THEN 1 END) * 100e0 / count(*) AS accuracy_score,
      100e0 - count(CASE WHEN value > 90 THEN 1 END) * 100e0 / count(*) AS consistency_score, 100e0 - count(CASE WHEN value > 60 THEN 1 END) * 80e0 / count(*) AS overall_quality_score
      FROM events GROUP BY user_id"""


BEFORE, AFTER = qa_runs(200, 110), qa_runs(260, 150)


def judged_runs(spark, sf, text=BEFORE):
    return findings.judged(frame(spark, sf, text))


_RATES = """SELECT dataset_name, (critical_errors + warnings) * 100e0 / (validation_checks + anomaly_checks) AS r FROM ({}) AS c"""


@query(
    "error_reduction",
    f"""WITH b AS ({_RATES.format(BEFORE)}), a AS ({_RATES.format(AFTER)}), j AS (SELECT b.dataset_name, b.r AS x, a.r AS y, greatest(0e0, 100 - b.r) AS p, greatest(0e0, 100 - a.r) AS q FROM b JOIN a ON a.dataset_name = b.dataset_name)
    SELECT dataset_name, round(x, 6) AS error_rate_before, round(y, 6) AS error_rate_after, round(CASE WHEN x > 0 THEN (x - y) / x * 100 ELSE 0 END, 3) AS error_reduction_percentage,
      round(CASE WHEN p > 0 THEN (q - p) / p * 100 ELSE 0 END, 3) AS quality_improvement_percentage, CASE WHEN x > 0 THEN (x - y) / x * 100 ELSE 0 END >= 40 AS improvement_achieved FROM j""",
)
def error_reduction(spark, sf):
    found = findings.error_reduction(judged_runs(spark, sf), judged_runs(spark, sf, AFTER))
    rates = {c: F.round(c, 6) for c in ("error_rate_before", "error_rate_after")}
    gains = {c: F.round(c, 3) for c in ("error_reduction_percentage", "quality_improvement_percentage")}
    return found.withColumns(rates | gains)


_FLAGS = """concat_ws(',', CASE overall_status WHEN 'FAILED' THEN 'QA_FAILED' WHEN 'WARNING' THEN 'QA_WARNING' END, CASE WHEN critical_errors > 0 THEN 'CRITICAL_ERRORS' END,
    CASE WHEN anomalies_found > 0 THEN 'ANOMALIES_DETECTED' END, CASE WHEN overall_quality_score < 70 THEN 'LOW_QUALITY_SCORE' WHEN overall_quality_score < 80 THEN 'MODERATE_QUALITY_SCORE' END,
    CASE WHEN completeness_score < 90 THEN 'INCOMPLETE_DATA' END, CASE WHEN accuracy_score < 95 THEN 'ACCURACY_ISSUES' END, CASE WHEN consistency_score < 90 THEN 'CONSISTENCY_ISSUES' END)"""


@query(
    "checkpoint",
    f"""SELECT 'facilities_load_1' AS checkpoint_id, 'load' AS stage, s.dataset_name, error_rate, quality_score, overall_status, may_continue, overall_quality_score, {_FLAGS} AS quality_flags
    FROM ({_LOAD}) AS s CROSS JOIN ({SQL['quality_grade']}) AS q""",
)
def one_checkpoint(spark, sf):
    from sievework.operators.scores import quality

    scores = quality(frame(spark, sf, FACILITIES), "facilities", AS_OF, ["registry_id", "facility_name", "latitude"], ["npdes_id"])
    row = checkpoint.checkpoint(load_run(spark, sf), scores, "facilities_load_1", "load", AS_OF)
    row = row.withColumn("quality_flags", F.array_join("quality_flags", ","))
    return rounded(row.select("checkpoint_id", "stage", "dataset_name", "error_rate", "quality_score", "overall_status", "may_continue", "overall_quality_score", "quality_flags"))


def checkpoints(spark, sf, text=BEFORE):
    """A checkpoint per user, with its flags."""
    scores = F.struct("overall_quality_score", "completeness_score", "accuracy_score", "consistency_score")
    stats = F.struct("overall_status", "critical_errors", "anomalies_found")
    return judged_runs(spark, sf, text).withColumn("quality_flags", findings.quality_flag_list(stats, scores))


def checkpoints_sql(text: str) -> str:
    return f"SELECT j.*, overall_quality_score, processing_seconds, {_FLAGS} AS flags FROM ({judged_sql(text)}) AS j JOIN ({text}) AS o ON o.dataset_name = j.dataset_name".replace(
        "critical_errors > 0", "j.critical_errors > 0"
    ).replace("anomalies_found > 0", "j.anomalies_found > 0")


def checkpoint_report_sql(text: str) -> str:
    return f"""SELECT count(*) AS total_checkpoints, count(*) FILTER (WHERE may_continue) AS passed_checkpoints, count(*) FILTER (WHERE may_continue) * 100e0 / count(*) AS success_rate,
      CAST(sum(records_processed) AS BIGINT) AS total_records, avg(overall_quality_score) AS average_quality_score,
      CAST(sum(CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END) AS BIGINT) AS total_quality_issues FROM ({checkpoints_sql(text)}) AS k"""


@query(
    "checkpoint_report",
    f"SELECT total_checkpoints, passed_checkpoints, round(success_rate, 6) AS success_rate, total_records, round(average_quality_score, 6) AS average_quality_score, total_quality_issues FROM ({checkpoint_report_sql(BEFORE)}) AS r",
)
def checkpoint_report(spark, sf):
    return rounded(checkpoint.checkpoint_report(checkpoints(spark, sf)))


@query("flag_counts", f"SELECT flag, count(*) AS flag_count FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM ({checkpoints_sql(BEFORE)}) AS k WHERE flags <> '') AS u GROUP BY flag")
def flag_counts(spark, sf):
    return checkpoint.flag_counts(checkpoints(spark, sf))


@query(
    "checkpoint_improvement",
    f"""WITH b AS ({checkpoint_report_sql(BEFORE)}), a AS ({checkpoint_report_sql(AFTER)})
    SELECT round(a.average_quality_score - b.average_quality_score, 6) AS quality_score_improvement, round(a.success_rate - b.success_rate, 6) AS success_rate_improvement,
      round((a.success_rate - b.success_rate) / (100 - b.success_rate) * 100, 6) AS error_reduction_percentage, (a.success_rate - b.success_rate) / (100 - b.success_rate) * 100 >= 42 AS target_met FROM b CROSS JOIN a""",
)
def checkpoint_improvement(spark, sf):
    before, after = (checkpoint.checkpoint_report(checkpoints(spark, sf, text)) for text in (BEFORE, AFTER))
    return rounded(checkpoint.checkpoint_improvement(before, after))


_PERFORMANCE = f"""SELECT count(*) AS total_datasets, CAST(sum(records_processed) AS BIGINT) AS total_records, round(sum(processing_seconds), 6) AS total_seconds,
    round(sum(records_processed) / sum(processing_seconds), 6) AS records_per_second, CAST(sum(validation_checks + anomaly_checks) AS BIGINT) AS total_checks,
    round(sum(validation_checks + anomaly_checks) / sum(processing_seconds), 6) AS checks_per_second, round(avg(quality_score), 4) AS average_quality_score, round(avg(error_rate), 4) AS average_error_rate,
    count(*) FILTER (WHERE overall_status = 'PASSED') AS datasets_passed, count(*) FILTER (WHERE overall_status = 'WARNING') AS datasets_with_warnings,
    count(*) FILTER (WHERE overall_status = 'FAILED') AS datasets_failed, round(count(*) FILTER (WHERE overall_status IN ('PASSED', 'WARNING')) * 100e0 / count(*), 6) AS overall_success_rate
    FROM ({checkpoints_sql(BEFORE)}) AS k"""


def performance_of(spark, sf):
    means = {c: F.round(c, 4) for c in ("average_quality_score", "average_error_rate")}
    return rounded(checkpoint.performance(judged_runs(spark, sf)).withColumns(means))


@query("qa_performance", _PERFORMANCE)
def qa_performance(spark, sf):
    return performance_of(spark, sf)


_SUMMARY = SQL["rule_summary"]
_FOUND = f"SELECT CAST(sum(anomaly_count) AS BIGINT) AS found, count(*) FILTER (WHERE severity_score > 0.8e0) AS severe FROM ({_DETECTED}) AS d"


@query(
    "executive_summary",
    f"""SELECT total_datasets, total_records, average_quality_score, records_per_second, CASE WHEN critical_count > 0 THEN 'CRITICAL ISSUES DETECTED' WHEN average_quality_score >= 90 THEN 'EXCELLENT'
      WHEN average_quality_score >= 80 THEN 'GOOD' WHEN average_quality_score >= 70 THEN 'ACCEPTABLE' ELSE 'NEEDS IMPROVEMENT' END AS overall_status,
      total_checks AS validation_checks, overall_pass_rate AS validation_pass_rate, critical_count AS critical_issues, found AS anomalies_detected,
      (SELECT round(avg(error_reduction_percentage), 3) FROM ({SQL['error_reduction']}) AS e) AS error_reduction_achieved
    FROM (SELECT total_datasets, total_records, average_quality_score, records_per_second FROM ({_PERFORMANCE}) AS x) AS p CROSS JOIN ({_SUMMARY}) AS v CROSS JOIN ({_FOUND}) AS a""",
)
def executive_summary(spark, sf):
    reduction = error_reduction(spark, sf)
    checked = rules.summary(results_of(spark, sf, FACILITIES, "facilities"))
    row = reports.executive_summary(performance_of(spark, sf), checked, anomalies.anomaly_summary(detected(spark, sf)), AS_OF, reduction)
    return rounded(row.drop("report_date").withColumn("error_reduction_achieved", F.round("error_reduction_achieved", 3)))


@query(
    "critical_issues",
    f"""SELECT 'CRITICAL_VALIDATION_ERRORS' AS issue_type, critical_count AS issue_count, 'HIGH' AS priority, critical_count || ' records break critical rules' AS description FROM ({_SUMMARY}) AS v WHERE critical_count > 0
    UNION ALL SELECT 'HIGH_SEVERITY_ANOMALIES', severe, 'MEDIUM', severe || ' detectors report a severity above 0.8' FROM ({_FOUND}) AS a WHERE severe > 0""",
)
def critical_issues(spark, sf):
    checked = rules.summary(results_of(spark, sf, FACILITIES, "facilities"))
    return reports.critical_issues(checked, detected(spark, sf)).drop("recommended_action")


@query(
    "recommendations",
    f"""SELECT 'DATA_QUALITY' AS category, 'HIGH' AS priority, 'Raise the average quality score' AS title, CAST(3 AS BIGINT) AS steps FROM ({_PERFORMANCE}) AS p WHERE average_quality_score < 80
    UNION ALL SELECT 'VALIDATION', 'MEDIUM', 'Let more rules pass', 3 FROM ({_SUMMARY}) AS v WHERE overall_pass_rate < 95""",
)
def recommendations(spark, sf):
    checked = rules.summary(results_of(spark, sf, FACILITIES, "facilities"))
    advice = reports.recommendations(performance_of(spark, sf), checked)
    return advice.select("category", "priority", "title", F.size("actions").cast("bigint").alias("steps"))


@query(
    "alerts",
    f"""SELECT 'QUALITY_SCORE_LOW' AS alert_type, 'WARNING' AS severity FROM ({_PERFORMANCE}) AS p WHERE average_quality_score < 70
    UNION ALL SELECT 'CRITICAL_ERRORS', 'CRITICAL' FROM ({_SUMMARY}) AS v WHERE critical_count > 0
    UNION ALL SELECT 'HIGH_ANOMALY_COUNT', 'WARNING' FROM ({_FOUND}) AS a WHERE found > 100""",
)
def alerts(spark, sf):
    checked = rules.summary(results_of(spark, sf, FACILITIES, "facilities"))
    raised = reports.alerts(performance_of(spark, sf), checked, anomalies.anomaly_summary(detected(spark, sf)), AS_OF)
    return raised.select("alert_type", "severity")


@query("rules_by_severity", f"SELECT severity, count(*) AS rule_count, string_agg(rule_name, ',' ORDER BY rule_name) AS rules FROM ({_FACILITY_RESULTS}) AS r GROUP BY severity")
def rules_by_severity(spark, sf):
    return reports.rules_by_severity(results_of(spark, sf, FACILITIES, "facilities"))


_BAND = "CASE WHEN {0} >= 90 THEN 'excellent_90_plus' WHEN {0} >= 80 THEN 'good_80_89' WHEN {0} >= 70 THEN 'acceptable_70_79' ELSE 'needs_improvement_below_70' END"


@query(
    "dataset_breakdown",
    f"SELECT {_BAND.format('quality_score')} AS band, count(*) AS datasets, round(avg(quality_score), 4) AS average_quality_score, count(*) FILTER (WHERE quality_score >= 80) AS datasets_above_threshold FROM ({judged_sql(BEFORE)}) AS j GROUP BY 1",
)
def dataset_breakdown(spark, sf):
    return rounded(reports.dataset_breakdown(judged_runs(spark, sf)), 4)


@query(
    "facility_ranking",
    "SELECT l_suppkey, mean_score, records, CAST(dense_rank() OVER (ORDER BY mean_score DESC) AS BIGINT) AS quality_rank FROM (SELECT l_suppkey, round(avg(l_quantity), 6) AS mean_score, count(*) AS records FROM lineitem GROUP BY l_suppkey) AS m",
)
def facility_ranking(spark, sf):
    return reports.facility_ranking(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity")


@query(
    "geographic_pattern",
    cte(f=FACILITIES)
    + "SELECT state_code, epa_region, count(*) AS records, round(avg(data_quality_score), 6) AS average_score, round(min(data_quality_score), 6) AS min_score, round(max(data_quality_score), 6) AS max_score FROM f GROUP BY ALL",
)
def geographic_pattern(spark, sf):
    return rounded(reports.geographic_pattern(frame(spark, sf, FACILITIES), ["state_code", "epa_region"], "data_quality_score"))


@query(
    "compliance_pattern",
    cte(f=FACILITIES)
    + """SELECT state_code, CAST(sum(violation_count) AS BIGINT) AS violations, CAST(sum(inspection_count) AS BIGINT) AS inspections,
      round(sum(violation_count) / nullif(CAST(sum(inspection_count) AS DOUBLE), 0), 6) AS violations_per_inspection, round(count(*) FILTER (WHERE violation_count > 0) * 100e0 / count(*), 6) AS violating_share FROM f GROUP BY state_code""",
)
def compliance_pattern(spark, sf):
    return rounded(reports.compliance_pattern(frame(spark, sf, FACILITIES), ["state_code"], "violation_count", "inspection_count"))


@query("score_distribution", cte(f=FACILITIES) + f"SELECT {_BAND.format('data_quality_score')} AS band, count(*) AS records FROM f GROUP BY 1")
def score_distribution(spark, sf):
    return reports.score_distribution(frame(spark, sf, FACILITIES), "data_quality_score")
