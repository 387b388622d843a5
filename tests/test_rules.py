"""Rule engine, rule book, scores and key checks."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sievework.operators import findings, keys, loadchecks, matching, rulebook, rules, runs, scores
from sievework.plans import checkpoint, corrections

AS_OF = datetime(2024, 6, 1)
FACILITIES = "registry_id string, facility_name string, state_code string, latitude double, longitude double, epa_region int, annual_emission_amount double"


@pytest.fixture(scope="module")
def facilities(spark):
    good = [(f"1100000000{i:02d}", f"Plant {i}", state, 30.5 + i, -90.5 - i, 4, 100.0 * i) for i, state in enumerate(["CA", "TX", "NY", "FL", "WA", "IL", "OH", "NC", "GA", "AZ"])]
    bad = [("INVALID_ID", "Somewhere", "INVALID", 91.0, -181.0, 15, 1.5e10), ("", "Nowhere", "CA", 0.0, 0.0, 9, 0.0), ("110000000099", " ", "ca", None, -100.0, 5, -1.0), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(good + bad, FACILITIES)


def outcome(df, book):
    return {r.rule_name: r for r in rules.evaluate(df, book).collect()}


def test_facility_rules(facilities):
    found = outcome(facilities, rulebook.all_rules(facilities.schema, "facilities", AS_OF))
    failed = {name: r.failed_count for name, r in found.items() if not r.passed}
    assert failed == {
        "required_fields_facilities": 3, "numeric_type_registry_id": 2, "string_format_facility_name": 1, "string_format_state_code": 1, "string_format_registry_id": 2,
        "coordinate_bounds_latitude": 1, "coordinate_bounds_longitude": 1, "epa_regions": 1, "state_codes": 1, "emission_ranges": 2, "coordinate_consistency": 1,
    }
    first = found["required_fields_facilities"]
    assert (first.severity, first.total_count, first.error_rate) == ("CRITICAL", 14, pytest.approx(300 / 14))
    assert found["numeric_type_latitude"].severity == "INFO"


def test_schema_and_names_give_equal_results(facilities):
    texts = facilities.select(*[F.col(c).cast("string").alias(c) for c in facilities.columns])
    typed = {n: r.failed_count for n, r in outcome(facilities, rulebook.all_rules(facilities.schema, "facilities", AS_OF)).items()}
    named = {n: r.failed_count for n, r in outcome(facilities, rulebook.all_rules(facilities.columns, "facilities", AS_OF)).items()}
    parsed = {n: r.failed_count for n, r in outcome(texts, rulebook.all_rules(texts.schema, "facilities", AS_OF)).items()}
    assert typed == named == parsed


def test_absent_required_column_fails_every_row(facilities):
    assert outcome(facilities, [rulebook.required_fields(facilities.columns, "permits")])["required_fields_permits"].failed_count == 14


def test_date_rules(spark):
    df = spark.createDataFrame([("2020-01-01", "2021-01-01"), ("2021-01-01", "2020-01-01"), ("nonsense", None), ("1960-01-01", "2099-01-01")], "effective_date string, expiration_date string")
    found = {n: r.failed_count for n, r in outcome(df, rulebook.all_rules(df.schema, "permits", AS_OF)).items()}
    assert (found["date_type_effective_date"], found["date_type_expiration_date"], found["permit_date_logic"]) == (2, 1, 1)


def test_user_rules_and_samples(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 10)
    book = [rules.Rule("sql", "v > 7", severity="CRITICAL"), rules.Rule("column", F.col("v") < 0)]
    found = outcome(df, book)
    assert (found["sql"].failed_count, found["sql"].severity, found["column"].passed) == (20, "CRITICAL", True)
    assert [r.id for r in rules.sample_failures(df, book, ["id"]).orderBy("sample_no").collect()] == [8, 9, 18, 19, 28, 29, 38, 39, 48, 49]
    with pytest.raises(ValueError):
        rules.evaluate(df, [])


def test_one_scan(facilities, tmp_path):
    facilities.write.parquet(str(tmp_path / "f"))
    df = facilities.sparkSession.read.parquet(str(tmp_path / "f"))
    plan = rules.evaluate(df, rulebook.all_rules(df.schema, "facilities", AS_OF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_status_and_gate(spark):
    rows = [("a", 10, 20, 0, 0, 0, 0), ("b", 10, 10, 10, 2, 0, 0), ("c", 10, 20, 0, 1, 4, 0), ("d", 10, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "dataset_name string, records_processed long, validation_checks long, anomaly_checks long, critical_errors long, warnings long, anomalies_found long")
    out = {r.dataset_name: r for r in findings.judged(df).collect()}
    assert {n: r.overall_status for n, r in out.items()} == {"a": "PASSED", "b": "FAILED", "c": "WARNING", "d": "ERROR"}
    assert [out[n].may_continue for n in "abcd"] == [True, False, True, False]
    assert out["b"].gate_message == "Critical error threshold exceeded: 10.0% (threshold: 5.0%)" and out["c"].error_rate == 25.0


def test_stage_run(facilities):
    run = checkpoint.run_stage(facilities, "facilities", "facilities", "extract", AS_OF)
    assert run.anomalies is None and run.statistics.first().critical_errors == 1
    assert findings.gate(run.statistics)[0] is False
    assert run.findings.filter("severity = 'CRITICAL'").count() == 1


def test_illegal_findings_stop(facilities):
    run = checkpoint.run_stage(facilities, "facilities", "facilities", "extract", AS_OF)
    with pytest.raises(ValueError):
        findings.store_findings(run.findings.withColumn("finding_type", F.lit("OTHER")), None)


def test_scores(facilities):
    row = scores.quality(facilities, "f", AS_OF, required=["registry_id", "facility_name"], keys=["registry_id"]).first()
    assert (row.total_records, row.complete_records, row.unique_records, row.consistent_records) == (14, 13, 14, 12)
    assert row.completeness_score == pytest.approx(1300 / 14)
    total = row.completeness_score * 0.25 + row.accuracy_score * 0.3 + row.consistency_score * 0.2 + row.uniqueness_score * 0.15 + row.timeliness_score * 0.1
    assert row.overall_quality_score == pytest.approx(total) and row.quality_grade == "A"


def test_null_keys_count_as_a_value(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, None), (2, "x")], "a int, b string")
    assert scores.uniqueness(df, ["a", "b"]).first().unique_records == 3


def test_grades_are_ordered(spark):
    df = spark.createDataFrame([("d", 50.0, "C"), ("e", 50.0, "A")], "dataset_name string, s double, g string")
    shaped = lambda grade: df.select("dataset_name", *[F.col("s").alias(f"{d}_score") for d in scores.DIMENSIONS], F.col("s").alias("overall_quality_score"), grade.alias("quality_grade"))
    out = scores.improvement(shaped(F.col("g")), shaped(F.lit("B"))).select("dataset_name", "grade_improved").distinct().collect()
    assert {r.dataset_name: r.grade_improved for r in out} == {"d": True, "e": False}


def test_keys(spark):
    child = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)] + [(100, None)], "id int, k string")
    parent = spark.createDataFrame([("hot", 1, 1), ("hot", 2, 2), ("k0", 3, 1), ("unused", 4, 1)], "k string, fid int, version int")
    resolved = {r.id: r.fid for r in keys.resolve(child, parent, "k", "fid", ["version"]).collect()}
    assert len(resolved) == 61 and resolved[1] == 2 and resolved[0] == 3 and resolved[3] is None and resolved[100] is None
    row = keys.consistency(child, parent, "k", "k").first()
    assert (row.total_rows, row.matched_rows, row.unmatched_rows) == (40 * 2 + 20, 81, 19)
    assert keys.orphans(child, parent, "k", "k").count() == 19 and keys.with_parent(child, parent, "k", "k").count() == 41
    assert keys.coverage(parent, child, "k", "k").first().coverage == pytest.approx(200 / 3)


def test_load_checks(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (1, None, 99.0), (None, None, None)], "id int, name string, lat double")
    out = {r.check_name: (r.value, r.status) for r in loadchecks.integrity(df, "t", "id", ["name"], latitude="lat").collect()}
    assert out == {"null_rows": (1.0, "WARN"), "primary_key_duplicates": (1.0, "FAIL"), "missing_name": (2.0, "WARN"), "invalid_latitude": (1.0, "FAIL"), "average_completeness": (pytest.approx(500 / 9), "WARN")}


def test_corrections(spark):
    df = spark.createDataFrame(
        [(1, "INVALID_ID", "", "ZZ", 99.0, 0.0, 15, 0.0, 20.0, 1900, "", -1, 0), (2, "110000000001", "A", "CA", 30.0, -90.0, 4, 8.0, 7.5, 2010, "AK1", 2, 0), (3, "110000000002", "B", "TX", None, None, 6, 4.0, 7.0, 2011, "AK2", 0, 0)],
        "n int, registry_id string, facility_name string, state_code string, latitude double, longitude double, epa_region int, annual_emission_amount double, ph_level double, measurement_year int, npdes_id string, compliance_violations int, inspection_count int",
    )
    fixes = corrections.standard_corrections(df, F.col("n"))
    out = {r.n: r for r in corrections.apply(df, fixes).collect()}
    assert out[1].registry_id == "110000000001" and out[1].annual_emission_amount == 6.0 and out[1].npdes_id == "XX0000001" and out[1].compliance_violations == 0
    assert out[2].inspection_count == 1 and out[3].latitude is None
    assert {r.correction: r.corrected for r in corrections.counts(df, fixes).collect()}["business_rules"] == 1
    assert corrections.analyse(corrections.apply(df, fixes)).agg(F.sum("failed_count")).first()[0] == 0


def brute_matches(left, right):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    alike = lambda a, b: 1 - distance(a, b) / max(len(a), len(b))
    return {
        (a[0], b[0]) for a in left for b in right
        if a[3] == b[3] and abs(a[4] - b[4]) <= 0.01 and abs(a[5] - b[5]) <= 0.01 and alike(a[1], b[1]) >= 0.85 and alike(a[2], b[2]) >= 0.8
    }


@pytest.mark.parametrize("crowded", [0, 5, 200])
def test_site_matches_equal_all_pairs(spark, crowded):
    names = ["NORTH WATER PLANT", "NORTH WATER PLANTS", "NORTHWATER PLANT", "SOUTH WATER PLANT", "MILL", "MILLS", "MIL", "AB", "EASTERN STEEL AND IRON WORKS", "EASTERN STEAL AND IRON WORK"]
    sites = [(i, names[i % len(names)], f"{100 + i % 7} MAIN STREET", "TX" if i % 4 else "CA", 30.0 + (i % 3) * 0.009, -95.0 - (i % 2) * 0.02) for i in range(120)]
    left, right = sites[:60], sites[60:]
    schema = "id int, name string, address string, state string, latitude double, longitude double"
    left, right = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    found = matching.match_sites(left, right, crowded=crowded)
    mine, yours = matching.site_members(left), matching.site_members(right)
    pairs = found.join(mine.toDF("a", "left_id"), "left_id").join(yours.toDF("b", "right_id"), "right_id")
    wanted = brute_matches(sites[:60], sites[60:])
    assert {(r.a, r.b) for r in pairs.collect()} == wanted
    assert found.agg(F.sum(F.col("left_copies") * F.col("right_copies"))).first()[0] == len(wanted)


def test_runs(spark):
    tasks = spark.createDataFrame([("a", "SUCCESS", 1.0), ("b", "SUCCESS", 1.0), ("b", "FAILED", 2.0), ("c", "FAILED", 2.0)], "run_id string, status string, duration_seconds double")
    assert {r.run_id: r.final_status for r in runs.task_rollup(tasks).collect()} == {"a": "SUCCESS", "b": "PARTIAL_SUCCESS", "c": "FAILED"}
    assert runs.dashboard(tasks).first().executed == 2
    one = spark.createDataFrame([("p", 10.0, 100.0, 50.0, 20.0)], "process_name string, duration_seconds double, records_per_second double, average_memory_mb double, average_cpu_percent double")
    two = one.withColumns({"duration_seconds": F.lit(5.0), "records_per_second": F.lit(150.0)})
    row = runs.compare(one, two).first()
    assert (row.time_improvement, row.speed_multiplier, row.throughput_improvement, row.target_met) == (50.0, 2.0, 50.0, True)


def test_constraints_skip_absent_columns(spark):
    df = spark.createDataFrame([(None, 5, 2050), ("x", 1, 2000)], "npdes_id string, measurement_quarter int, measurement_year int")
    found = {n: r.failed_count for n, r in outcome(df, rulebook.constraints("water_measurements", df.schema, AS_OF)).items()}
    assert found == {"not_null_npdes_id": 1, "not_null_measurement_year": 0, "not_null_measurement_quarter": 0, "check_measurement_year": 1, "check_measurement_quarter": 1}


def test_timeliness(spark):
    df = spark.createDataFrame([("2024-05-20",), ("2024-01-01",), ("2030-01-01",), ("bad",), (None,)], "last_date string")
    row = scores.timeliness(df, AS_OF).first()
    assert (row.total_records, row.current_records, row.timeliness_score) == (5, 2, pytest.approx(200 / 3))
    assert scores.timeliness(spark.createDataFrame([(date(2024, 5, 31),)], "seen_date date"), AS_OF).first().avg_data_age_days == 1.0


def test_column_scores_count_distinct_values_of_every_type_without_copying_rows(spark):
    rows = spark.sql(
        """SELECT * FROM VALUES (1, -0.0D, 'a', DATE '2024-01-01', true, array(1, 2), 1.10, named_struct('x', 1, 'y', CAST(NULL AS STRING))),
        (1, 0.0D, ' ', DATE '2024-01-02', NULL, array(1, 2), 1.1, named_struct('x', 1, 'y', '')), (NULL, double('NaN'), NULL, NULL, false, array(1), 2, NULL),
        (2, double('NaN'), 'a', NULL, true, NULL, NULL, named_struct('x', 1, 'y', '')) AS t(`a whole.one`, d, s, day, yes, many, price, pair)"""
    )
    found = scores.column_scores(rows)
    total, columns = rows.count(), rows.columns
    for row in found.collect():
        value = F.col(f"`{row.column_name}`")
        n, distinct, valid = rows.agg(F.count(value), F.count_distinct(value), F.count_if(F.length(F.trim(value)) > 0) if row.column_name == "s" else F.count(value)).first()
        assert (row.completeness, row.uniqueness, row.validity) == (n * 100.0 / total, distinct * 100.0 / total, valid * 100.0 / n)
    assert [r.column_name for r in found.collect()] == columns
    assert "Expand" not in found._jdf.queryExecution().toString()
    empty = scores.column_scores(rows.limit(0)).collect()
    assert [r.column_name for r in empty] == columns and {r.uniqueness for r in empty} == {0.0}
