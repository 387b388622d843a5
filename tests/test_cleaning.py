"""Cleaning steps on small frames with planted defects."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sievework.functions.parsing import EARLIEST, LATEST, decimal_places, to_date_flexible, to_identifier, to_number, to_whole
from sievework.functions.scoring import region_from_position, unit_factor, unit_name
from sievework.functions.text import ASCII_WORD, clean_name, has_token, search_tokens, similarity, snake_case
from sievework.operators import cleaning
from sievework.operators.dedup import keep_first, natural_keys, remove_duplicates
from sievework.operators.ordering import dealt_out
from sievework.plans.transform import transform
from sievework.sources.catalog import source

AS_OF = datetime(2024, 6, 1)


def values(spark, expression, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.select(expression(F.col("v")).alias("out"), "i").orderBy("i").select("out").collect()]


@pytest.mark.parametrize(
    "raw, snake",
    [("REGISTRY_ID", "registry_id"), ("FAC_EPA_REGION", "fac_epa_region"), ("CWA_COMPLIANCE_STATUS", "cwa_compliance_status"), ("NUME90Q", "nume90_q"), ("yearqtr", "yearqtr"), ("FacName", "fac_name")],
)
def test_snake_case(raw, snake):
    assert snake_case(raw) == snake


def test_tokens_are_whole_words():
    assert has_token("fac_lat", "lat") and not has_token("violation_count", "lat") and not has_token("total_penalties", "penalty")


def test_names(spark):
    cases = {
        "  NORTH   CORP ": "NORTH CORPORATION", "SOUTH CO INC": "SOUTH COMPANY INCORPORATED", "A&B": "AANDB", "EAST CO & SONS LLC": "EAST COMPANY  SONS LIMITED LIABILITY COMPANY",
        "CITY (WWTP)": "CITY (WASTEWATER TREATMENT PLANT)", "BAD@#$%": "BAD", "WEST ltd.": "WEST ltd.", "CO": "COMPANY", "ÉCO-CO": "ÉCO-COMPANY", "COR": "CORPORATION", "": None, None: None,
    }
    assert values(spark, clean_name, list(cases)) == list(cases.values())


def test_names_with_the_word_boundaries_of_sql(spark):
    cases = {"ÍCO UN": "ÍCOMPANY UN", "COÓ": "COMPANYÓ", "É&A": "ÉA", "A&B": "AANDB", "XCO CO_": "XCO CO_", "SOUTH CO": "SOUTH COMPANY"}
    assert values(spark, lambda c: clean_name(c, ASCII_WORD), list(cases)) == list(cases.values())


def test_rows_are_dealt_out_before_costly_work(spark):
    rows = spark.range(600, numPartitions=1).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("b"))
    dealt = dealt_out(rows)
    assert dealt.columns == rows.columns and dealt.exceptAll(rows).isEmpty() and rows.exceptAll(dealt).isEmpty()
    assert "Rebalance" in dealt._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_and_ids(spark):
    assert values(spark, to_number, ["1.5", " 2 ", "12D", "many", "", None, "1e3"]) == [1.5, 2.0, None, None, None, None, 1000.0]
    assert values(spark, to_whole, ["5", "5.0", "5.9", "x"]) == [5, 5, 5, None]
    assert [None if v is None else int(v) for v in values(spark, to_identifier, ["110030441779.0", "110012538968", "invalid"])] == [110030441779, 110012538968, None]


def test_dates(spark):
    cases = {
        "2023-01-05": date(2023, 1, 5), "2023-1-5": date(2023, 1, 5), "06/11/2002": date(2002, 6, 11), "6-1-2002": date(2002, 6, 1), "2023/02/03": date(2023, 2, 3), "25/12/2020": date(2020, 12, 25),
        "25-12-2020": date(2020, 12, 25), "20200131": date(2020, 1, 31), "12312020": date(2020, 12, 31), "2020-01-31 10:30:00": date(2020, 1, 31), "Jan 5, 2021": date(2021, 1, 5),
        "2023-02-30": None, "0001-01-01": date(1, 1, 1), "9999-12-31": date(9999, 12, 31), "2023": None, "2023-05": None, "invalid": None, "": None, None: None,
    }
    assert values(spark, to_date_flexible, list(cases)) == list(cases.values())
    assert values(spark, lambda c: to_date_flexible(c, (EARLIEST, LATEST)), ["9999-12-31", "2020-01-31"]) == [None, date(2020, 1, 31)]
    typed = spark.sql("SELECT DATE '2020-01-31' AS d, TIMESTAMP '2020-01-31 23:59:59' AS t, TIMESTAMP_NTZ '2020-01-31 00:00:01' AS n")
    assert set(typed.select(*[to_date_flexible(F.col(c)) for c in "dtn"]).first()) == {date(2020, 1, 31)}


def test_decimal_places(spark):
    assert values(spark, decimal_places, [34.0522, 34.0, 0.00001, 1.123456789, 1.12345678], "double") == [4, 1, 5, 9, 8]


def test_regions_keep_the_published_first_match(spark):
    points = [(45.0, -75.0, 1), (45.0, -120.0, 1), (36.0, -80.0, 3), (36.0, -95.0, 5), (36.0, -112.0, None), (36.0, -120.0, 9), (32.0, -100.0, 6), (20.0, -80.0, None)]
    df = spark.createDataFrame(points, "lat double, lon double, wanted int")
    assert df.filter(~region_from_position(F.col("lat"), F.col("lon")).eqNullSafe(F.col("wanted"))).count() == 0


def test_units_ignore_case(spark):
    assert values(spark, unit_name, ["lbs", "Short Tons", "stone"]) == ["Pounds", "Short Tons", "STONE"]
    assert values(spark, unit_factor, ["kg", "METRIC TONS", "stone", None]) == [2.20462, 2204.62, 1.0, 1.0]


def test_missing_values_and_defaults(spark):
    df = spark.createDataFrame([(1, "A", "CA", None, "Y", 5, 10.0), (None, None, "TX", "Y", None, None, None), (3, "C", None, None, None, 1, 5.0)],
                               "registry_id long, fac_name string, fac_state string, fac_active_flag string, fac_major_flag string, fac_inspection_count int, fac_total_penalties double")
    out = cleaning.default_values(cleaning.mark_missing(df, ["registry_id", "fac_name", "fac_state"])).collect()
    assert [r[cleaning.MISSING_REQUIRED] for r in out] == [False, True, True]
    assert [(r.fac_active_flag, r.fac_major_flag, r.fac_inspection_count, r.fac_total_penalties) for r in out] == [("Y", "Y", 5, 10.0), ("Y", "N", 0, None), ("Y", "N", 1, 5.0)]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_duplicates_do_not_depend_on_partitions(spark, parts):
    rows = [("AK1", 20143, None, i) for i in range(50)] + [("TX1", 20144, "S", i) for i in range(50)] + [(None, 20143, None, 7), (None, 20143, None, 3)]
    df = spark.createDataFrame(rows, "npdes_id string, yearqtr int, hlrnc string, n int").repartition(parts)
    assert natural_keys(df.columns) == ["npdes_id", "yearqtr"]
    assert sorted((r.npdes_id or "", r.n) for r in remove_duplicates(df, ["n"]).collect()) == [("", 3), ("AK1", 0), ("TX1", 0)]
    assert remove_duplicates(df.select("hlrnc"), []).count() == 2


def test_dedup_cuts_groups_before_the_shuffle(spark):
    plan = keep_first(spark.range(100).selectExpr("id % 3 AS k", "id"), ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


def test_compliance_scores_by_hand(spark):
    df = spark.createDataFrame([("GOOD", 0, 0, 0, 0), ("POOR", 5, 3, 2, 1), ("FAIR", 2, 1, 1, 0), ("NONE", None, None, None, None)], "id string, nume90_q int, numcvdt int, numpsch int, numsvcd int")
    out = {r.id: (r.compliance_score, r.is_compliant) for r in cleaning.score_compliance(df).collect()}
    assert out == {"GOOD": (100.0, True), "POOR": (0.0, False), "FAIR": (52.5, False), "NONE": (100.0, True)}


def test_quality_flags(spark):
    df = spark.createDataFrame(
        [(1, "Good", 39.0, -120.0, 9, date(2023, 1, 1), "CA"), (None, None, 999.0, -200.0, 15, date(2025, 1, 1), "CA"), (3, "Fair", 45.0, -95.0, 5, date(2022, 1, 1), None)],
        "registry_id long, fac_name string, fac_lat double, fac_long double, fac_epa_region int, fac_date_last_inspection date, fac_state string",
    )
    coordinates = ["fac_lat", "fac_long"]
    marked = cleaning.mark_missing(cleaning.clean_coordinates(df, coordinates), ["registry_id", "fac_name"])
    out = cleaning.quality_flags(marked, coordinates, AS_OF).collect()
    assert [r.data_quality_flags for r in out] == ["CLEAN", "MISSING_REQUIRED|OUT_OF_RANGE|INVALID_COORDS|ANOMALY|MANUAL_REVIEW", "ANOMALY|MANUAL_REVIEW"]
    assert out[0].data_quality_score == 1.0 and out[1].requires_manual_review and out[2].data_quality_score == pytest.approx(0.9 * 6 / 7)


def test_penalty_dates_are_no_amounts(spark):
    df = spark.createDataFrame([(date(2020, 1, 1), 6e7), (date(2020, 1, 1), 1.0)], "fac_date_last_penalty date, last_penalty double")
    out = df.select(cleaning.out_of_range(df.select("last_penalty"), []).alias("x")).collect()
    assert [r.x for r in out] == [True, False]


def test_whole_transform(spark):
    raw = spark.createDataFrame(
        [("110030441779", " NORTH CORP ", "ca", "6", "29.95", "-91.99", None), ("110030441779", "NORTH CORP", "CA", "6", "29.95", "-91.99", "N"), ("bad", "X", "TX", "15", "999", "0", "Y")],
        "REGISTRY_ID string, FAC_NAME string, FAC_STATE string, FAC_EPA_REGION string, FAC_LAT string, FAC_LONG string, FAC_ACTIVE_FLAG string",
    )
    out = {r.fac_name: r for r in transform(raw, source("echo_facilities"), AS_OF).collect()}
    assert set(out) == {"NORTH CORPORATION", "X"}
    assert int(out["NORTH CORPORATION"].registry_id) == 110030441779 and out["NORTH CORPORATION"].fac_state == "CA"
    assert out["X"].fac_lat is None and out["X"].fac_epa_region is None and out["X"].data_quality_flags == "MISSING_REQUIRED|INVALID_COORDS|MANUAL_REVIEW"


def test_search_and_similarity(spark):
    assert values(spark, search_tokens, ["Clean Water, clean AIR!"]) == [["clean", "water", "air"]]
    assert values(spark, lambda c: similarity(c, F.lit("abcd")), ["abcd", "abce", ""]) == [1.0, 0.75, 0.0]
