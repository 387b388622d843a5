"""Reading, staging, upserts, loads and streams."""

from pathlib import Path
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievework.plans import load
from sievework.plans import transform as transforming
from sievework.sources import catalog, delimited, export, runlog, tables as stored
from sievework.sources.catalog import source
from sievework.sources.tables import Tables
from sievework.streaming import ingest, windows

AS_OF = datetime(2024, 6, 1)


@pytest.fixture()
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"))


def measurements(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("NPDES_ID,YEARQTR,HLRNC,NUME90Q,NUMCVDT,NUMSVCD,NUMPSCH,NUMD8090Q\n" + "\n".join(lines) + "\n")


def test_delimited(spark, tmp_path):
    measurements(tmp_path / "in", "a.csv", ["AK1,20231,S,1,x,0,0,", " ak2 ,20232,null,2,3,,,0", ",,,,,,,", '"AK,3",20233,"say ""hi""",1,1,1,1,1'])
    config = source("npdes_measurements")
    raw = delimited.read_delimited(spark, str(tmp_path / "in"), config, with_order=True)
    rows = sorted(delimited.clean_raw(raw, config).collect(), key=lambda r: r.YEARQTR)
    assert [(r.NPDES_ID, r.HLRNC, r.NUME90Q, r.NUMCVDT) for r in rows] == [("AK1", "S", 1, None), ("ak2", None, 2, 3), ("AK,3", 'say "hi"', 1, 1)]


def test_structure_and_catalog(spark):
    issues = delimited.structure_issues(spark, ["NPDES_ID", "EXTRA"], source("npdes_measurements")).collect()
    assert ("missing_required", "ERROR", "YEARQTR") in [tuple(i) for i in issues] and ("extra_column", "WARNING", "EXTRA") in [tuple(i) for i in issues]
    with pytest.raises(ValueError):
        source("nothing")
    with pytest.raises(ValueError):
        load.to_core(spark.range(1), "nothing", AS_OF)
    ready = {r.source_name: r for r in catalog.readiness(spark, {"good": catalog.as_config(source("air_emissions")), "bad": {"name": "x"}}, ["qa_findings"]).collect()}
    assert ready["good"].valid and not ready["bad"].valid and ready["good"].findings_table_exists


def test_stage_is_idempotent(spark, tables):
    for batch, rows in ((1, 5), (2, 7), (2, 7)):
        tables.stage(spark.range(rows), "t", batch, "f.csv", order=("id",))
    assert tables.batch("t", 1).count() == 5 and tables.batch("t", 2).count() == 7
    assert [r.etl_row_number for r in tables.batch("t", 2).orderBy("id").collect()] == list(range(1, 8))
    assert "PartitionFilters: [isnotnull(etl_batch_id" in tables.batch("t", 2)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("partition_by", [(), ("y",)])
def test_upsert(spark, tables, partition_by):
    first = spark.createDataFrame([(1, 2000, "a", "old", "old"), (2, 2001, "b", "old", "old"), (None, None, "n", "old", "old")], "k int, y int, v string, created_by string, updated_by string")
    second = spark.createDataFrame([(2, 2001, "x", "new", "new"), (2, 2001, "y", "new", "new"), (3, 2001, "c", "new", "new"), (None, None, "m", "new", "new")], first.schema)
    for df in (first, second, second):
        tables.upsert(df, "t", ["k", "y"], partition_by=partition_by)
    rows = tables.read("t").collect()
    out = {r.k: (r.v, r.created_by, r.updated_by) for r in rows if r.k}
    assert out == {1: ("a", "old", "old"), 2: ("y", "old", "new"), 3: ("c", "new", "new")}
    # a key with a null is in conflict with none: every load of such a row is there
    assert sorted((r.v, r.created_by) for r in rows if r.k is None) == [("m", "new"), ("m", "new"), ("n", "old")]


def leaf_files(tables, name):
    """The data files of the current version, by partition."""
    known, found = tables.manifest(name), {}
    for version, leaves in known["leaves"].items():
        for leaf in leaves:
            folder = Path(tables.path(name)) / f"v{version}" / leaf
            found[leaf] = sorted(str(f) for f in folder.glob("*.parquet"))
    return found


@pytest.mark.parametrize("partition_by", [(), ("y",), ("y", "z")])
def test_upsert_writes_touched_partitions_only(spark, tables, partition_by):
    base = spark.range(400).selectExpr("id AS k", "int(id % 5) AS y", "if(id % 3 = 0, null, concat('z/=', id % 3)) AS z", "'old' AS v")
    keys = ["k", "y", "z"] if partition_by else ["k"]
    tables.upsert(base, "t", keys, partition_by=partition_by)
    before = leaf_files(tables, "t")
    assert len(before) == {(): 16, ("y",): 5, ("y", "z"): 15}[partition_by]
    change = base.filter("k = 7").withColumn("v", F.lit("new")).withColumn("more", F.lit(1))
    tables.upsert(change, "t", keys, partition_by=partition_by)
    after = leaf_files(tables, "t")
    changed = [leaf for leaf in after if after[leaf] != before.get(leaf)]
    assert len(changed) == 1 and set(after) == set(before)
    got = {r.k: (r.v, r.more) for r in tables.read("t").collect()}
    assert len(got) == 400 and got[7] == ("new", 1) and set(got.values()) == {("old", None), ("new", 1)}
    assert set(tables.read("t").columns) == {"k", "y", "z", "v", "more"}
    tables.upsert(change.limit(0), "t", keys, partition_by=partition_by)
    assert leaf_files(tables, "t") == after
    with pytest.raises(ValueError):
        tables.append(base, "t")


def test_broken_upsert_leaves_the_old_rows(spark, tables):
    base = spark.range(100).selectExpr("id AS k", "int(id % 4) AS y", "'old' AS v")
    tables.upsert(base, "t", ["k", "y"], partition_by=("y",))
    bad = base.filter("y = 1").withColumn("v", F.when(F.col("k") == 97, F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        tables.upsert(bad, "t", ["k", "y"], partition_by=("y",))
    assert sorted(map(tuple, tables.read("t").collect())) == sorted(map(tuple, base.select(*tables.read("t").columns).collect()))
    tables.upsert(base.filter("y = 1").withColumn("v", F.lit("new")), "t", ["k", "y"], partition_by=("y",))
    assert tables.read("t").filter("v = 'new'").count() == 25 and tables.read("t").count() == 100


def test_versions_expire_but_carried_partitions_stay(spark, tables):
    base = spark.range(60).selectExpr("id AS k", "int(id % 6) AS y", "0 AS v")
    tables.upsert(base, "t", ["k", "y"], partition_by=("y",))
    for step in range(1, 13):  # more versions than a manifest carries partitions over from
        tables.upsert(base.filter(f"y = {step % 5}").withColumn("v", F.lit(step)), "t", ["k", "y"], partition_by=("y",))
        if step % 4 == 0:
            tables.expire("t")
        assert len(tables.manifest("t")["leaves"]) <= 9
    want = {y: max(s for s in range(0, 13) if s == 0 or s % 5 == y) for y in range(5)} | {5: 0}
    got = tables.read("t").groupBy("y").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("k").alias("n")).collect()
    assert {r.y: (r.low, r.high, r.n) for r in got} == {y: (v, v, 10) for y, v in want.items()}
    assert len(tables.versions("t")) == 2


def test_parts_of_an_append_are_written_once(spark, tables):
    for _ in range(2):
        tables.append(spark.range(4), "p", part="first")
    tables.append(spark.range(3), "p", part="second")
    assert tables.read("p").count() == 7


def test_truncate_counts_and_info(spark, tables):
    tables.append(spark.range(4), "t")
    tables.append(spark.range(3), "t")
    assert tables.info("t").first().row_count == 7
    tables.truncate("t")
    assert [tuple(r) for r in tables.row_counts().collect()] == [("core", "t", 0)] and tables.read("t").columns == ["id"]
    with pytest.raises(ValueError):
        tables.read("absent")


def test_run_log(spark):
    log = runlog.open_batch(spark, 7, "load", datetime(2024, 1, 1), "f.csv").unionByName(runlog.close_batch(spark, 7, "FAILED", datetime(2024, 1, 2), processed=5, error="lost"))
    row = runlog.current_runs(log.unionByName(runlog.open_batch(spark, 8, "load", datetime(2024, 1, 3)))).orderBy("batch_id").collect()
    assert [(r.batch_id, r.status, r.process_name, r.records_processed, r.error_message) for r in row] == [(7, "FAILED", "load", 5, "lost"), (8, "RUNNING", "load", 0, None)]
    with pytest.raises(ValueError):
        runlog.close_batch(spark, 7, "DONE", AS_OF)


def test_export(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, named_struct('x', 2, 'y', named_struct('z', 'q\"r')) AS b, array(1, 2) AS c")
    export.export_report(df, str(tmp_path / "csv"), "csv")
    assert tuple(spark.read.options(header=True, escape='"').csv(str(tmp_path / "csv")).first()) == ("1", "2", 'q"r', "[1,2]")
    export.export_report(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().b.y.z == 'q"r'
    with pytest.raises(ValueError):
        export.export_report(df, str(tmp_path / "x"), "xml")


def test_parameters_are_bound(spark):
    df = stored.query(spark, "SELECT id FROM {t} WHERE id = :id OR :name = 'x'", {"id": 3, "name": "' OR true --"}, t=spark.range(10))
    assert [r.id for r in df.collect()] == [3]


def test_core_projection(spark):
    df = spark.createDataFrame([("AK1", "20233", "S", 4, 1)], "npdes_id string, yearqtr string, hlrnc string, nume90q int, numcvdt int")
    row = load.to_core(df, "water_measurements", AS_OF).first()
    assert (row.measurement_year, row.measurement_quarter, row.effluent_violations_90day, row.created_by) == (2023, 3, 4, "etl_system")
    flags = spark.createDataFrame([("y", None)], "fac_active_flag string, air_flag string")
    row = load.to_core(flags, "facilities", AS_OF).first()
    assert (row.is_active, row.has_air_permits) == (True, False)


def test_failed_load_is_logged(spark, tables):
    with pytest.raises(Exception):
        load.load_source(spark, tables, spark.range(1).select(F.raise_error(F.lit("lost")).alias("NPDES_ID")), source("npdes_measurements"), 3, AS_OF)
    assert runlog.current_runs(tables.read("etl_run_log")).first().status == "FAILED"


def test_stream_resumes_and_gate_stops(spark, tmp_path, tables):
    config = source("npdes_measurements")
    run = lambda gate: ingest.ingest(ingest.file_stream(spark, str(tmp_path / "in"), config), config, tables, str(tmp_path / "check"), AS_OF, "water_measurements", enforce_gate=gate)
    measurements(tmp_path / "in", "a.csv", ["AK1,20231,S,1,0,0,0,0", "AK1,20231,S,1,0,0,0,0", "AK2,20231,S,1,0,0,0,0"])
    run(False).awaitTermination()
    run(False).awaitTermination()
    assert tables.read("npdes_measurements", "staging").count() == 2
    measurements(tmp_path / "in", "b.csv", [",20231,S,1,0,0,0,0"])
    with pytest.raises(Exception, match="GateClosed"):
        run(True).awaitTermination()
    assert tables.read("npdes_measurements", "staging").count() == 2
    run(False).awaitTermination()
    assert tables.read("npdes_measurements", "staging").count() == 3


def test_batch_forms_of_stream_operators(spark):
    rows = [(1, "memory_usage", 90.0, datetime(2024, 1, 1, 0, 5)), (2, "memory_usage", 10.0, datetime(2024, 1, 1, 0, 10)), (3, "memory_usage", 99.0, datetime(2024, 1, 1, 0, 20)), (4, "other", 1e9, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "id int, metric_name string, metric_value double, ts timestamp_ntz")
    out = sorted((r.window_start.minute, r.checks, r.breaches, r.alert) for r in windows.sla_windows(df).collect())
    assert out == [(0, 2, 1, True), (15, 1, 1, True)]
    assert windows.drop_repeats(df.union(df), ["id"], "ts").count() == 4


def test_file_of_another_layout_stops_the_read(spark, tmp_path, tables):
    config = source("npdes_measurements")
    measurements(tmp_path / "in", "a.csv", ["AK1,20231,S,1,0,0,0,0"])
    (tmp_path / "in" / "b.csv").write_text("EXTRA,NPDES_ID,YEARQTR,HLRNC,NUME90Q,NUMCVDT,NUMSVCD,NUMPSCH,NUMD8090Q\nzz,AK2,20231,S,1,0,0,0,0\n")
    with pytest.raises(Exception, match="(?i)header"):
        delimited.read_delimited(spark, str(tmp_path / "in"), config, header=list(config.columns)).collect()
    with pytest.raises(Exception, match="(?i)header"):
        ingest.ingest(ingest.file_stream(spark, str(tmp_path / "in"), config, list(config.columns)), config, tables, str(tmp_path / "check"), AS_OF).awaitTermination()


def test_leading_column_does_not_shift_a_stream(spark, tmp_path, tables):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.csv").write_text("EXTRA,NPDES_ID,YEARQTR,HLRNC,NUME90Q,NUMCVDT,NUMSVCD,NUMPSCH,NUMD8090Q\nzz,AK2,20231,S,1,0,0,0,0\n")
    config = source("npdes_measurements")
    ingest.ingest(ingest.file_stream(spark, str(tmp_path / "in"), config), config, tables, str(tmp_path / "check"), AS_OF, "water_measurements", enforce_gate=False).awaitTermination()
    row = tables.read("npdes_measurements", "staging").first()
    assert (row.extra, row.npdes_id, row.yearqtr) == ("zz", "AK2", "20231")


def test_repeats_of_other_batches_and_malformed_rows(spark, tmp_path, tables):
    config = source("npdes_measurements")
    # years out of range lose their value later, yet stay keys of their own
    lines = ["AK1,20231,S,1,0,0,0,0", "AK2,19001,S,1,0,0,0,0", ",20231,S,1,0,0,0,0"]
    measurements(tmp_path / "in", "a.csv", lines)
    measurements(tmp_path / "in", "b.csv", [*lines, "AK2,19002,S,1,0,0,0,0", "AK3,20231", '"AK4",20231,"a ""b"",c",1,0,0,0,0,7'])
    stream = ingest.file_stream(spark, str(tmp_path / "in"), config, files_per_batch=1)
    ingest.ingest(stream, config, tables, str(tmp_path / "check"), AS_OF, "water_measurements", enforce_gate=False).awaitTermination()
    assert tables.read("npdes_measurements", "staging").count() == 6
    counted = {r.file_path[-5:]: (r.row_count, r.malformed_count, r.empty_count) for r in delimited.malformed_rows(spark, str(tmp_path / "in"), config).collect()}
    assert counted == {"a.csv": (3, 0, 0), "b.csv": (6, 2, 0)}


def test_batches_and_parts(spark, tables):
    first = runlog.batch_of(tables, "p", "one", AS_OF)
    assert runlog.batch_of(tables, "p", "two", AS_OF) != first and runlog.batch_of(tables, "p", "one", AS_OF) == first
    assert tables.claim("name") and not tables.claim("name")
    with pytest.raises(ValueError):
        runlog.numbered(tables, first, "q", AS_OF)
    for rows in (3, 2, 0):
        tables.put(spark.range(rows), "t", "batch-1")
        tables.put(spark.range(4), "t", "batch-2")
        assert tables.read("t").count() == rows + 4
    with pytest.raises(ValueError):
        tables.put(spark.range(1), "t", "a/b")


def test_load_again_doubles_nothing(spark, tables):
    raw = spark.createDataFrame([("AK1", "20231", "S", "1")], "NPDES_ID string, YEARQTR string, HLRNC string, NUME90Q string")
    for _ in range(2):
        load.load_source(spark, tables, raw, source("npdes_measurements"), None, AS_OF, key="2024-06-01")
    assert tables.read("etl_run_log").count() == 2 and tables.read("water_measurements").count() == 1
    lineage = tables.read("data_lineage")
    assert lineage.count() == lineage.select("source_column", "target_column").distinct().count()


ECHO = "REGISTRY_ID string, FAC_NAME string, FAC_STATE string, FAC_EPA_REGION string, FAC_CITY string, NPDES_FLAG string"
ICIS = "NPDES_ID string, FACILITY_UIN string, FACILITY_NAME string, STATE_CODE string, CITY string, ZIP string"


@pytest.mark.parametrize("first", ["echo_facilities", "icis_facilities"])
def test_masters_of_two_sources(spark, tables, first):
    """Whichever source comes first, ECHO's values stay and ICIS fills in; sites without UIN stay in staging."""
    rows = {
        "echo_facilities": spark.createDataFrame([("110000000001", "A", "TX", "6", None, "N"), ("110000000002", "B", "TX", "6", "WACO", None)], ECHO),
        "icis_facilities": spark.createDataFrame(
            [("TX0000001", "110000000001", "OTHER", "TX", "AUSTIN", "78701"), (None, "110000000003", "C", "TX", None, None), ("TX0000004", None, "D", "TX", None, None)], ICIS
        ),
    }
    order = [first, *[name for name in rows if name != first]]
    for batch, name in enumerate([*order, first], start=1):
        load.load_source(spark, tables, rows[name], source(name), batch, AS_OF)
    found = tables.read("facilities").collect()
    assert sorted((int(r.registry_id), r.facility_name, r.city, r.zip_code, bool(r.has_water_permits)) for r in found) == [
        (110000000001, "A", "AUSTIN", "78701", True), (110000000002, "B", "WACO", None, False), (110000000003, "C", None, None, False),
    ]
    assert len({r.facility_id for r in found}) == 3 and tables.read("icis_facilities", "staging").count() >= 3


def test_compliance_history_once_per_period(spark, tables):
    facilities = spark.createDataFrame([("110000000001", "A", "TX", "6", None, "N"), ("110000000002", "B", "TX", "6", None, "N")], ECHO)
    load.load_source(spark, tables, facilities, source("echo_facilities"), 1, AS_OF)
    columns = "REGISTRY_ID string, PROGRAM_TYPE string, COMPLIANCE_YEAR string, COMPLIANCE_QUARTER string, TOTAL_PENALTIES string"
    for batch, amount in ((2, "5"), (3, "7")):
        periods = [("110000000001", "WATER", "2020", "1", amount), ("110000000002", "WATER", "2020", "1", "1"), ("110000000001", "WATER", "2020", None, amount),
                   ("110000000009", "WATER", "2020", "1", "9"), ("110000000001", "AIR", None, "1", "9"), (None, "AIR", "2020", "1", "9")]
        load.load_source(spark, tables, spark.createDataFrame(periods, columns), source("compliance_history"), batch, AS_OF)
    rows = [(int(r.registry_id), r.compliance_quarter, r.total_penalties) for r in tables.read("compliance_history").collect()]
    assert sorted(rows, key=repr) == [(110000000001, 1, 7.0), (110000000001, None, 7.0), (110000000002, 1, 1.0)]


def test_transform_stats_in_one_scan(spark):
    """Counts of all rows come with the rows that stay; the plan reads its input once."""
    raw = spark.createDataFrame([("AK1", "20231", "S", "1")] * 3 + [("AK2", "20231", "S", None), (None, "20231", "S", "1")], "NPDES_ID string, YEARQTR string, HLRNC string, NUME90Q string")
    stats = transforming.transform_stats(raw, source("npdes_measurements"), AS_OF)
    row = stats.first()
    assert (row.input_rows, row.output_rows, row.duplicates_removed, row.rows_flagged, row.completeness_before) == (5, 3, 2, 1, 18 / 20)
    assert stats._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 2  # one, shown again as the initial plan
    empty = transforming.transform_stats(raw.limit(0), source("npdes_measurements"), AS_OF).first()
    assert (empty.input_rows, empty.output_rows, empty.rows_flagged, empty.completeness_before) == (0, 0, 0, 0.0)


def test_a_batch_is_copied_once_and_its_copies_go(spark, tmp_path):
    config, copies = source("npdes_measurements"), []

    class Watched(Tables):
        def copied(self, df, path):
            copies.append(path.rsplit("/", 1)[-1])
            return super().copied(df, path)

    tables = Watched(spark, str(tmp_path / "lake"))
    measurements(tmp_path / "in", "a.csv", ["AK1,20231,S,1,0,0,0,0", "AK1,20231,S,1,0,0,0,0"])
    measurements(tmp_path / "in", "b.csv", ["AK1,20231,S,1,0,0,0,0", "AK2,20231,S,1,0,0,0,0"])
    stream = ingest.file_stream(spark, str(tmp_path / "in"), config, files_per_batch=1)
    ingest.ingest(stream, config, tables, str(tmp_path / "check"), AS_OF, "water_measurements", enforce_gate=False).awaitTermination()
    assert tables.read("npdes_measurements", "staging").count() == 2
    assert copies == ["whole", "whole", "clean"]  # the first batch has nothing to compare with
    assert not list((tmp_path / "lake" / "work").iterdir())
