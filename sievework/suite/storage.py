"""Reading, staging, upserting and exporting tables. Every query writes below the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.plans import load
from sievework.sources import delimited, export, tables as stored
from sievework.sources.catalog import core_table, source
from sievework.sources.lineage import lineage
from sievework.sources.tables import Tables
from sievework.suite.cleaning import RAW_MEASUREMENTS
from sievework.suite.frames import cte
from sievework.suite.registry import AS_OF, frame, query, rounded, scratch, table


def written(spark, sf, text: str) -> str:
    """The frame as CSV files with a header."""
    path = scratch(spark)
    frame(spark, sf, text).write.option("header", True).csv(path)
    return path


@query(
    "csv_extract",
    cte(t=RAW_MEASUREMENTS)
    + """SELECT NULLIF(trim(NPDES_ID), 'null') AS npdes_id, YEARQTR AS yearqtr, HLRNC AS hlrnc, CAST(NUME90Q AS BIGINT) AS e90, CAST(sum(try_cast(NUMCVDT AS BIGINT)) AS BIGINT) AS cvdt, count(*) AS n FROM t GROUP BY ALL""",
)
def csv_extract(spark, sf):
    """Write, read with the declared strings, clean and type."""
    config = source("npdes_measurements")
    rows = delimited.read_delimited(spark, written(spark, sf, RAW_MEASUREMENTS), config, with_order=True)
    clean = delimited.clean_raw(rows, config)
    keys = [F.col(c).alias(n) for c, n in (("NPDES_ID", "npdes_id"), ("YEARQTR", "yearqtr"), ("HLRNC", "hlrnc"), ("NUME90Q", "e90"))]
    return clean.groupBy(*keys).agg(F.sum("NUMCVDT").alias("cvdt"), F.count(F.lit(1)).alias("n"))


@query("malformed_rows", "SELECT count(*) AS row_count, count(*) FILTER (WHERE l_linenumber = 2 OR l_linenumber = 3) AS malformed_count, count(*) FILTER (WHERE l_linenumber = 4) AS empty_count FROM lineitem")
def malformed_rows(spark, sf):
    """Lines with too few and too many values are kept and counted."""
    path = scratch(spark)
    line = "CASE l_linenumber WHEN 2 THEN 'AK1,20231' WHEN 3 THEN 'AK1,20231,S,1,0,0,0,0,9' WHEN 4 THEN ',,,,,,,' ELSE 'AK1,20231,S,1,0,0,0,0' END"
    table(spark, sf, "lineitem").selectExpr(f"{line} AS `NPDES_ID,YEARQTR,HLRNC,NUME90Q,NUMCVDT,NUMSVCD,NUMPSCH,NUMD8090Q`").write.options(header=True, sep="|").csv(path)
    counted = delimited.malformed_rows(spark, path, source("npdes_measurements"))
    return counted.agg(*[F.sum(c).alias(c) for c in ("row_count", "malformed_count", "empty_count")])


RAW_FACILITIES = """
SELECT CAST(110000000000 + c_custkey AS STRING) AS REGISTRY_ID, c_name AS FAC_NAME, CASE WHEN c_nationkey = 3 THEN '??' WHEN c_nationkey = 4 THEN '' ELSE 'TX' END AS FAC_STATE,
       CASE WHEN c_nationkey = 5 THEN 'ten' ELSE CAST(c_nationkey AS STRING) END AS FAC_EPA_REGION, CAST(c_acctbal / 64e0 AS STRING) AS FAC_LAT, CAST(c_nationkey * 10 - 200 AS STRING) AS FAC_LONG,
       CASE WHEN c_acctbal < 3000 THEN c_mktsegment END AS FAC_COUNTY
FROM customer
"""


@query(
    "extract_warnings",
    cte(t=RAW_FACILITIES)
    + """, m AS (SELECT *, try_cast(FAC_LAT AS DOUBLE) AS lat, try_cast(FAC_LONG AS DOUBLE) AS lon, try_cast(FAC_EPA_REGION AS DOUBLE) AS region FROM t)
    SELECT 'coordinates_FAC_LAT' AS check_name, count(*) FILTER (WHERE lat < -90 OR lat > 90) AS warning_count, count(*) AS total_count FROM m
    UNION ALL SELECT 'coordinates_FAC_LONG', count(*) FILTER (WHERE lon < -180 OR lon > 180), count(*) FROM m
    UNION ALL SELECT 'epa_region', count(*) FILTER (WHERE region < 1 OR region > 10), count(*) FROM m
    UNION ALL SELECT 'state_code', count(*) FILTER (WHERE FAC_STATE = '??'), count(*) FROM m
    UNION ALL SELECT 'corrupt_rows', 0, count(*) FROM m""",
)
def extract_warnings(spark, sf):
    return delimited.sanity_counts(frame(spark, sf, RAW_FACILITIES), source("echo_facilities"), AS_OF.year)


_DECLARED = source("echo_facilities")
_EXPECTED = ", ".join(f"('{c}', {str(c in _DECLARED.required).lower()})" for c in dict.fromkeys([*_DECLARED.columns, *_DECLARED.required]))


@query(
    "extract_structure",
    f"""WITH present AS (SELECT column_name FROM (DESCRIBE SELECT * FROM ({RAW_FACILITIES}) AS t) UNION ALL SELECT name FROM pragma_table_info('customer') WHERE name = 'c_mktsegment'),
    expected AS (SELECT * FROM (VALUES {_EXPECTED}) AS v(column_name, required))
    SELECT 'missing_required' AS issue, 'ERROR' AS level, column_name FROM expected WHERE required AND column_name NOT IN (SELECT column_name FROM present)
    UNION ALL SELECT 'missing_expected', 'WARNING', column_name FROM expected WHERE column_name NOT IN (SELECT column_name FROM present)
    UNION ALL SELECT 'extra_column', 'WARNING', column_name FROM present WHERE column_name NOT IN (SELECT column_name FROM expected)""",
)
def extract_structure(spark, sf):
    """The header of a written extract against the declared columns; one column is none of the source's."""
    path = written(spark, sf, RAW_FACILITIES.replace("FROM customer", ", c_mktsegment FROM customer"))
    config = source("echo_facilities")
    return delimited.structure_issues(spark, delimited.header_of(spark, path, config), config)


@query("extract_sample", "SELECT CAST(least(count(*), 500) AS BIGINT) AS sampled_rows FROM orders")
def extract_sample(spark, sf):
    """The sampling sink: how many rows come, any of them."""
    path = scratch(spark)
    delimited.write_sample(table(spark, sf, "orders"), path, 500)
    return spark.read.option("header", True).csv(path).agg(F.count(F.lit(1)).alias("sampled_rows"))


@query(
    "staging_write_read",
    "SELECT o_orderkey, o_totalprice, CAST(2 AS BIGINT) AS etl_batch_id, 'orders.csv' AS etl_source_file, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS etl_row_number FROM orders WHERE o_orderstatus <> 'O'",
)
def staging_write_read(spark, sf):
    """Two batches staged, the second one twice; the second one read."""
    rows, tables = table(spark, sf, "orders"), Tables(spark, scratch(spark))
    tables.stage(rows.filter("o_orderstatus = 'O'"), "orders", 1, "orders.csv")
    for _ in range(2):
        tables.stage(rows.filter("o_orderstatus <> 'O'"), "orders", 2, "orders.csv", order=("o_orderkey",))
    return tables.batch("orders", 2).select("o_orderkey", "o_totalprice", "etl_batch_id", "etl_source_file", "etl_row_number")


# Open orders have another key when they are loaded first, so that the second load updates some and adds others.
OLD = "SELECT CASE WHEN o_orderstatus = 'O' THEN -1 - o_orderkey ELSE o_orderkey END AS o_orderkey, o_custkey, o_totalprice, 'first' AS created_by, 'first' AS updated_by, CAST(year(o_orderdate) AS INT) AS order_year FROM orders"
NEW = "SELECT o_orderkey, o_custkey, o_totalprice + 1e0 AS o_totalprice, 'second' AS created_by, 'second' AS updated_by, CAST(year(o_orderdate) AS INT) AS order_year FROM orders WHERE o_orderpriority <= '2-HIGH' AND o_orderdate >= DATE '1998-01-01'"
_UPSERTED = (
    cte(a=OLD, b=NEW)
    + """SELECT b.o_orderkey, b.o_custkey, round(b.o_totalprice, 4) AS o_totalprice, coalesce(a.created_by, b.created_by) AS created_by, b.updated_by, b.order_year FROM b LEFT JOIN a ON a.o_orderkey = b.o_orderkey
    UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice, 4), created_by, updated_by, order_year FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)"""
)


def upserted(spark, sf, keys, partition_by=()):
    tables = Tables(spark, scratch(spark))
    for text in (OLD, NEW):
        tables.upsert(frame(spark, sf, text), "orders", keys, partition_by=partition_by)
    return rounded(tables.read("orders").select("o_orderkey", "o_custkey", "o_totalprice", "created_by", "updated_by", "order_year"), 4)


@query("upsert", _UPSERTED)
def upsert(spark, sf):
    return upserted(spark, sf, ["o_orderkey"])


@query("upsert_partitions", _UPSERTED)
def upsert_partitions(spark, sf):
    """Only the years the second load touches are written again."""
    return upserted(spark, sf, ["o_orderkey", "order_year"], ("order_year",))


@query(
    "upsert_null_keys",
    """SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, count(*) FILTER (WHERE o_orderstatus = 'F') AS without_key, count(*) FILTER (WHERE o_orderstatus <> 'F') AS with_key
    FROM (SELECT * FROM (SELECT CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS o_orderkey, o_orderstatus FROM orders) AS a
    UNION ALL SELECT NULL, o_orderstatus FROM orders WHERE o_orderstatus = 'F') AS t""",
)
def upsert_null_keys(spark, sf):
    """Rows without a key are in conflict with none: two loads of them are all there."""
    orders = frame(spark, sf, "SELECT CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS o_orderkey, o_orderstatus, o_totalprice FROM orders")
    tables = Tables(spark, scratch(spark))
    tables.upsert(orders, "orders", ["o_orderkey"])
    tables.upsert(orders, "orders", ["o_orderkey"])
    none = F.col("o_orderstatus") == "F"
    return tables.read("orders").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("keys"), F.count_if(none).alias("without_key"), F.count_if(~none).alias("with_key"))


@query("table_row_counts", """SELECT 'staging' AS table_schema, 'events' AS table_name, count(*) AS row_count FROM events UNION ALL SELECT 'core', 'orders', count(*) FROM orders UNION ALL SELECT 'core', 'customer', 0""")
def table_row_counts(spark, sf):
    """Counts after an append, a replacement and a truncation."""
    tables = Tables(spark, scratch(spark))
    tables.stage(table(spark, sf, "events"), "events", 1, "events.csv")
    orders = table(spark, sf, "orders")
    tables.append(orders.filter("o_orderstatus = 'O'"), "orders")
    tables.append(orders.filter("o_orderstatus <> 'O'"), "orders")
    tables.replace(table(spark, sf, "customer"), "customer")
    tables.truncate("customer")
    return tables.row_counts()


@query(
    "table_facts",
    """SELECT 'core.supplier' AS table_name, count(*) AS row_count, CAST(4 AS INT) AS column_count, unnest(['s_suppkey', 's_name', 's_nationkey', 's_acctbal']) AS column_name, unnest(['bigint', 'string', 'int', 'double']) AS data_type FROM supplier""",
)
def table_facts(spark, sf):
    tables = Tables(spark, scratch(spark))
    tables.replace(table(spark, sf, "supplier"), "supplier")
    return tables.info("supplier")


@query("sql_parameters", "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O' GROUP BY o_orderpriority")
def sql_parameters(spark, sf):
    return stored.query(
        spark, "SELECT o_orderpriority, count(*) AS orders FROM {orders} WHERE o_totalprice > :floor AND o_orderstatus = :status GROUP BY o_orderpriority",
        {"floor": 150000, "status": "O"}, orders=table(spark, sf, "orders"),
    )


@query("report_export", "SELECT o_orderpriority AS priority, CAST(count(*) AS VARCHAR) AS totals_orders, CAST(max(o_orderkey) AS VARCHAR) AS totals_keys_last, '[\"' || string_agg(DISTINCT o_orderstatus, '\",\"' ORDER BY o_orderstatus) || '\"]' AS statuses FROM orders GROUP BY o_orderpriority")
def report_export(spark, sf):
    """A nested report written as CSV: paths become names, lists become JSON."""
    report = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.struct(F.count(F.lit(1)).alias("orders"), F.struct(F.max("o_orderkey").alias("last")).alias("keys")).alias("totals"),
        F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"),
    )
    path = scratch(spark)
    export.export_report(report, path, "csv")
    return spark.read.options(header=True, escape='"').csv(path)


# A facility per customer and three pollutants per line, as the transformed extracts would be staged.
SITES = """
SELECT CAST(110000000000 + c_custkey AS STRING) AS REGISTRY_ID, c_name AS FAC_NAME, 'TX' AS FAC_STATE, '6' AS FAC_EPA_REGION, '30.12345' AS FAC_LAT, '-95.54321' AS FAC_LONG, 'Y' AS FAC_ACTIVE_FLAG
FROM customer WHERE c_mktsegment <> 'BUILDING'
"""
RELEASES = """
SELECT CAST(year(o_orderdate) AS STRING) AS REPORTING_YEAR, CAST(110000000000 + o_custkey AS STRING) AS REGISTRY_ID, 'TRIS' AS PGM_SYS_ACRNM, CAST(o_orderkey AS STRING) AS PGM_SYS_ID,
       POLLUTANT AS POLLUTANT_NAME, CAST(o_totalprice AS STRING) AS ANNUAL_EMISSION, 'Tons' AS UNIT_OF_MEASURE, 'X' AS NEI_TYPE, 'HAP' AS NEI_HAP_VOC_FLAG
FROM orders LATERAL VIEW explode(array('LEAD', 'BENZENE', 'NOX')) AS POLLUTANT
"""


@query(
    "core_load",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS reporting_year, 3 * count(*) AS rows, 3 * count(c_custkey) AS with_facility, round(3 * sum(o_totalprice), 2) AS emission
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING' GROUP BY 1""",
)
def core_load(spark, sf):
    """Two sources transformed, staged and upserted; the second finds its facilities in the first.

    A release is told by facility, year, pollutant and program, so all three pollutants of a facility's year stay.
    """
    tables = Tables(spark, scratch(spark))
    load.load_source(spark, tables, frame(spark, sf, SITES), source("echo_facilities"), 1, AS_OF)
    load.load_source(spark, tables, frame(spark, sf, RELEASES), source("air_emissions"), 2, AS_OF)
    loaded = tables.read("air_emissions").groupBy(F.col("reporting_year").cast("bigint").alias("reporting_year"))
    return rounded(loaded.agg(F.count(F.lit(1)).alias("rows"), F.count("facility_id").alias("with_facility"), F.sum("annual_emission_amount").alias("emission")), 2)


# Every supplier as an ICIS site: the even ones under the registry id of a customer, some of those left out by ECHO.
ICIS_SITES = """
SELECT CAST(s_suppkey AS STRING) AS ICIS_FACILITY_INTEREST_ID, concat('TX', CAST(1000000 + s_suppkey AS STRING)) AS NPDES_ID,
       CAST(CASE WHEN s_suppkey % 2 = 0 THEN 110000000000 ELSE 120000000000 END + s_suppkey AS STRING) AS FACILITY_UIN, s_name AS FACILITY_NAME, 'TOWN' AS CITY, 'TX' AS STATE_CODE,
       '31.5' AS GEOCODE_LATITUDE, '-96.5' AS GEOCODE_LONGITUDE FROM supplier
"""


@query(
    "core_masters",
    """WITH e AS (SELECT 110000000000 + c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING'),
    i AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 110000000000 ELSE 120000000000 END + s_suppkey AS id, true AS water FROM supplier),
    m AS (SELECT e.id IS NOT NULL AS echo, i.id IS NOT NULL AS icis, coalesce(i.water, false) AS water FROM e FULL OUTER JOIN i ON e.id = i.id)
    SELECT CASE WHEN echo THEN '30.12345' ELSE '31.5' END AS latitude, icis AS has_city, water AS has_water_permits, echo AS is_active, count(*) AS sites, count(*) AS keys FROM m GROUP BY ALL""",
)
def core_masters(spark, sf):
    """ICIS sites and ECHO facilities in one master: ECHO's values first, open ones from ICIS, sites that only one knows."""
    tables = Tables(spark, scratch(spark))
    load.load_source(spark, tables, frame(spark, sf, ICIS_SITES), source("icis_facilities"), 1, AS_OF)
    load.load_source(spark, tables, frame(spark, sf, SITES), source("echo_facilities"), 2, AS_OF)
    masters = tables.read("facilities").select(
        F.col("latitude").cast("string").alias("latitude"), F.col("city").isNotNull().alias("has_city"),
        F.coalesce("has_water_permits", F.lit(False)).alias("has_water_permits"),
        F.coalesce("is_active", F.lit(False)).alias("is_active"), "facility_id",
    )
    return masters.groupBy("latitude", "has_city", "has_water_permits", "is_active").agg(F.count(F.lit(1)).alias("sites"), F.count_distinct("facility_id").alias("keys"))


# A year of a customer's orders is a compliance period; every order comes again and urgent ones tell no quarter.
PERIODS = """
SELECT CAST(110000000000 + o_custkey AS STRING) AS REGISTRY_ID, 'WATER' AS PROGRAM_TYPE, CAST(year(o_orderdate) AS STRING) AS COMPLIANCE_YEAR,
       CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(quarter(o_orderdate) AS STRING) END AS COMPLIANCE_QUARTER, '2' AS INSPECTION_COUNT, CAST(o_orderdate AS STRING) AS LAST_INSPECTION_DATE,
       'Y' AS HAS_SIGNIFICANT_NONCOMPLIANCE FROM orders
"""


@query(
    "core_compliance_history",
    """SELECT DISTINCT o_custkey + 110000000000 AS registry_id, year(o_orderdate) AS y, CASE WHEN o_orderpriority <> '1-URGENT' THEN quarter(o_orderdate) END AS q
    FROM orders JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING'""".join(
        ("SELECT CAST(y AS BIGINT) AS compliance_year, CAST(q AS BIGINT) AS compliance_quarter, count(*) AS rows, CAST(2 * count(*) AS BIGINT) AS inspections FROM (", ") AS d GROUP BY 1, 2")
    ),
)
def core_compliance_history(spark, sf):
    """Periods of facilities upserted twice: one row for each facility, programme, year and quarter, those without a quarter too.

    Periods of unknown facilities are refused.
    """
    tables = Tables(spark, scratch(spark))
    load.load_source(spark, tables, frame(spark, sf, SITES), source("echo_facilities"), 1, AS_OF)
    for batch in (2, 3):
        load.load_source(spark, tables, frame(spark, sf, PERIODS), source("compliance_history"), batch, AS_OF)
    rows = tables.read("compliance_history").groupBy(*[F.col(c).cast("bigint").alias(c) for c in ("compliance_year", "compliance_quarter")])
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("inspection_count").cast("bigint").alias("inspections"))


@query(
    "load_lineage",
    """SELECT u.s AS source_column, u.t AS target_column, u.k AS transformation_type, n AS source_record_count, n AS target_record_count FROM (SELECT 3 * count(*) AS n FROM orders) AS c CROSS JOIN
      (VALUES ('registry_id', 'registry_id', 'DIRECT_COPY'), ('reporting_year', 'reporting_year', 'DIRECT_COPY'), ('pollutant_name', 'pollutant_name', 'DIRECT_COPY'), ('annual_emission', 'annual_emission_amount', 'DIRECT_COPY'),
      ('unit_of_measure', 'emission_unit_of_measure', 'DIRECT_COPY'), ('pgm_sys_acrnm', 'program_system_acronym', 'DIRECT_COPY'), ('pgm_sys_id', 'program_system_id', 'DIRECT_COPY'), ('registry_id', 'facility_id', 'LOOKUP')) AS u(s, t, k)""",
)
def load_lineage(spark, sf):
    staged = frame(spark, sf, RELEASES)
    staged = staged.toDF(*[c.lower() for c in staged.columns])
    rows = lineage(spark, core_table("air_emissions"), staged, load.to_core(staged, "air_emissions", AS_OF), 2, AS_OF)
    return rows.select("source_column", "target_column", "transformation_type", "source_record_count", "target_record_count")


@query("stable_keys", "SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS keys FROM lineitem")
def stable_keys(spark, sf):
    """Surrogate keys are as distinct as the natural ones."""
    keyed = table(spark, sf, "lineitem").select(stored.stable_key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"))
    return keyed.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("key").alias("keys"))


