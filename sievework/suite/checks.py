"""Validation rules, key checks, quality scores, profiles and load checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sievework.functions import codes
from sievework.operators import keys, loadchecks, matching, profile, rulebook, rules, scores, views
from sievework.suite.frames import EMISSIONS, FACILITIES, MEASUREMENTS, PERMITS, RUNS, cte
from sievework.suite.registry import AS_OF, TODAY, frame, query, rounded, table

STATES_SQL = "(" + ", ".join(f"'{s}'" for s in codes.STATE_CODES) + ")"


def rules_sql(frame_name: str, checks: list[tuple[str, str, str]]) -> str:
    """Result rows of (rule, severity when failing, condition)."""
    parts = [
        f"SELECT '{n}' AS rule_name, CASE WHEN count(*) FILTER (WHERE {c}) = 0 THEN 'INFO' ELSE '{s}' END AS severity, "
        f"count(*) FILTER (WHERE {c}) = 0 AS passed, count(*) FILTER (WHERE {c}) AS failed_count, count(*) AS total_count, "
        f"round(count(*) FILTER (WHERE {c}) * 100e0 / count(*), 6) AS error_rate FROM {frame_name}"
        for n, s, c in checks
    ]
    return " UNION ALL ".join(parts)


def number(column: str) -> str:
    return f"try_cast({column} AS DOUBLE)"


FACILITY_CHECKS = [
    ("required_fields_facilities", "CRITICAL", "registry_id IS NULL OR trim(registry_id) = '' OR facility_name IS NULL OR trim(facility_name) = '' OR state_code IS NULL"),
    ("numeric_type_registry_id", "WARNING", f"registry_id IS NOT NULL AND {number('registry_id')} IS NULL"),
    *[(f"numeric_type_{c}", "WARNING", "false") for c in ("latitude", "longitude", "epa_region", "annual_emission_amount", "measurement_year")],
    ("string_format_facility_name", "WARNING", "trim(facility_name) = ''"),
    ("string_format_state_code", "WARNING", f"upper(trim(state_code)) NOT IN {STATES_SQL}"),
    ("string_format_npdes_id", "WARNING", f"NOT regexp_matches(trim(npdes_id), '{codes.NPDES_ID_PATTERN}')"),
    ("string_format_registry_id", "WARNING", r"NOT regexp_matches(trim(registry_id), '^\d{11,12}$')"),
    ("coordinate_bounds_latitude", "WARNING", "latitude < -90 OR latitude > 90"),
    ("coordinate_bounds_longitude", "WARNING", "longitude < -180 OR longitude > 180"),
    ("epa_regions", "WARNING", "epa_region NOT BETWEEN 1 AND 10"),
    ("state_codes", "WARNING", f"upper(trim(state_code)) NOT IN {STATES_SQL}"),
    ("year_range_measurement_year", "WARNING", "measurement_year < 1970 OR measurement_year > 2024"),
    ("emission_ranges", "WARNING", "annual_emission_amount < 0 OR annual_emission_amount > 1000000000"),
    ("coordinate_consistency", "WARNING", "(latitude IS NULL) <> (longitude IS NULL)"),
]
PERMIT_CHECKS = [
    ("required_fields_permits", "CRITICAL", "npdes_id IS NULL OR trim(npdes_id) = '' OR external_permit_number IS NULL OR permit_type_code IS NULL OR trim(permit_type_code) = ''"),
    ("numeric_type_total_design_flow_mgd", "WARNING", "false"),
    ("date_type_effective_date", "WARNING", "effective_date < DATE '1970-01-01' OR effective_date > DATE '2025-01-30'"),
    ("date_type_expiration_date", "WARNING", "expiration_date < DATE '1970-01-01' OR expiration_date > DATE '2025-01-30'"),
    ("string_format_npdes_id", "WARNING", f"NOT regexp_matches(npdes_id, '{codes.NPDES_ID_PATTERN}')"),
    ("flow_ranges_total_design_flow_mgd", "WARNING", "total_design_flow_mgd < 0 OR total_design_flow_mgd > 10000"),
    ("flow_ranges_actual_average_flow_mgd", "WARNING", "actual_average_flow_mgd < 0 OR actual_average_flow_mgd > 10000"),
    ("permit_date_logic", "WARNING", "effective_date >= expiration_date"),
    ("flow_consistency", "WARNING", "actual_average_flow_mgd > total_design_flow_mgd"),
]
EMISSION_CHECKS = [
    ("required_fields_air_emissions", "CRITICAL", "registry_id IS NULL OR reporting_year IS NULL OR pollutant_name IS NULL OR trim(pollutant_name) = ''"),
    *[(f"numeric_type_{c}", "WARNING", "false") for c in ("registry_id", "annual_emission_amount", "reporting_year")],
    ("string_format_pollutant_name", "WARNING", "trim(pollutant_name) = ''"),
    ("string_format_registry_id", "WARNING", r"NOT regexp_matches(registry_id, '^\d{11,12}$')"),
    ("year_range_reporting_year", "WARNING", "reporting_year < 1970 OR reporting_year > 2024"),
    ("emission_ranges", "WARNING", "annual_emission_amount < 0 OR annual_emission_amount > 1000000000"),
]
_SHOWN = ["rule_name", "severity", "passed", "failed_count", "total_count", "error_rate"]


def results_of(spark, sf, text, name):
    rows = frame(spark, sf, text)
    return rules.evaluate(rows, rulebook.all_rules(rows.schema, name, AS_OF))


@query("rule_results", cte(e=EMISSIONS) + rules_sql("e", EMISSION_CHECKS))
def rule_results(spark, sf):
    """All rules of the largest table in one scan."""
    return rounded(results_of(spark, sf, EMISSIONS, "air_emissions").select(*_SHOWN))


@query("facility_rules", cte(f=FACILITIES) + rules_sql("f", FACILITY_CHECKS))
def facility_rules(spark, sf):
    return rounded(results_of(spark, sf, FACILITIES, "facilities").select(*_SHOWN))


@query("permit_rules", cte(p=PERMITS) + rules_sql("p", PERMIT_CHECKS))
def permit_rules(spark, sf):
    return rounded(results_of(spark, sf, PERMITS, "permits").select(*_SHOWN))


@query(
    "rule_summary",
    cte(f=FACILITIES)
    + f", r AS ({rules_sql('f', FACILITY_CHECKS)}) "
    + """SELECT count(*) AS total_checks, count(*) FILTER (WHERE passed) AS passed_checks, count(*) FILTER (WHERE NOT passed) AS failed_checks,
        count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count, count(*) FILTER (WHERE severity = 'WARNING') AS warning_count,
        count(*) FILTER (WHERE severity = 'INFO') AS info_count, CAST(floor(sum(total_count) / count(*)) AS BIGINT) AS records_validated,
        CAST(sum(failed_count) AS BIGINT) AS record_failures, round(count(*) FILTER (WHERE passed) * 100e0 / count(*), 6) AS overall_pass_rate,
        round(count(*) FILTER (WHERE NOT passed) * 100e0 / count(*), 6) AS overall_error_rate,
        round(sum(failed_count) * 100e0 / floor(sum(total_count) / count(*)), 6) AS record_failure_rate FROM r""",
)
def rule_summary(spark, sf):
    return rounded(rules.summary(results_of(spark, sf, FACILITIES, "facilities")))


@query(
    "top_failures",
    cte(f=FACILITIES) + f", r AS ({rules_sql('f', FACILITY_CHECKS)}) SELECT rule_name, error_rate, failed_count FROM r WHERE NOT passed ORDER BY error_rate DESC, rule_name LIMIT 10",
)
def top_failures(spark, sf):
    return rounded(rules.top_failures(results_of(spark, sf, FACILITIES, "facilities")).drop("error_message"))


@query(
    "sample_failures",
    cte(e=EMISSIONS)
    + ", x AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS rule_name, l_orderkey, l_linenumber, l_partkey FROM e WHERE {c}" for n, _, c in EMISSION_CHECKS)
    + "), k AS (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY l_orderkey, l_linenumber, l_partkey) AS sample_no FROM x) SELECT rule_name, l_orderkey, l_linenumber, l_partkey, CAST(sample_no AS INT) AS sample_no FROM k WHERE sample_no <= 10",
)
def sample_failures(spark, sf):
    rows = frame(spark, sf, EMISSIONS)
    book = rulebook.all_rules(rows.schema, "air_emissions", AS_OF)
    return rules.sample_failures(rows, book, ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "failing_row_counts",
    cte(p=PERMITS) + " UNION ALL ".join(f"SELECT '{n}' AS rule_name, count(*) AS rows_failing FROM p WHERE {c} HAVING count(*) > 0" for n, _, c in PERMIT_CHECKS),
)
def failing_row_counts(spark, sf):
    rows = frame(spark, sf, PERMITS)
    failing = rules.failing_rows(rows, rulebook.all_rules(rows.schema, "permits", AS_OF), ["permit_id"])
    return failing.groupBy("rule_name").agg(F.count(F.lit(1)).alias("rows_failing"))


DECLARED = f"SELECT m.*, CASE WHEN event_id > 0 THEN nume90_q * 2e0 END AS ph_value FROM ({MEASUREMENTS}) AS m"


@query(
    "declared_sets",
    cte(m=DECLARED)
    + rules_sql(
        "m",
        [
            ("code_set_hlrnc", "WARNING", "hlrnc NOT IN ('', ' ', 'S', 'C', 'X', 'T', 'D', 'E')"),
            ("ph_range_ph_value", "WARNING", "ph_value < 0 OR ph_value > 14"),
            *[(f"violation_count_{c}", "WARNING", f"{c} < 0 OR {c} > 999") for c in ("nume90_q", "numcvdt", "numsvcd", "numpsch")],
            ("pattern_yearqtr", "WARNING", r"NOT regexp_matches(yearqtr, '^(19|20)\d{2}[1-4]$')"),
        ],
    ),
)
def declared_sets(spark, sf):
    rows = frame(spark, sf, DECLARED)
    return rounded(rules.evaluate(rows, rulebook.declared_sets(rows.schema)).select(*_SHOWN))


@query(
    "declared_emission_sets",
    cte(e=EMISSIONS) + rules_sql("e", [("code_set_unit_of_measure", "WARNING", "unit_of_measure NOT IN ('Pounds', 'Tons', 'Kilograms', 'Grams', 'Short Tons', 'Metric Tons')")]),
)
def declared_emission_sets(spark, sf):
    rows = frame(spark, sf, EMISSIONS)
    return rounded(rules.evaluate(rows, rulebook.declared_sets(rows.schema)).select(*_SHOWN))


@query(
    "constraint_rules",
    cte(p=PERMITS)
    + rules_sql(
        "p",
        [
            *[(f"not_null_{c}", "CRITICAL", f"{c} IS NULL") for c in ("facility_id", "external_permit_number", "permit_type_code", "permit_status_code")],
            ("check_total_design_flow_mgd", "WARNING", "total_design_flow_mgd < 0"),
            ("check_actual_average_flow_mgd", "WARNING", "actual_average_flow_mgd < 0"),
            ("check_major_minor_status", "WARNING", "major_minor_status NOT IN ('Major', 'Minor', 'N')"),
            ("check_expiration_date", "WARNING", "effective_date >= expiration_date"),
        ],
    ),
)
def constraint_rules(spark, sf):
    rows = frame(spark, sf, PERMITS)
    return rounded(rules.evaluate(rows, rulebook.constraints("permits", rows.schema, AS_OF)).select(*_SHOWN))


@query(
    "user_rules",
    "SELECT 'ship_before_order' AS rule_name, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS failed_count, count(*) AS total_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "UNION ALL SELECT 'large_discount', count(*) FILTER (WHERE l_discount * l_extendedprice > 5000), count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def user_rules(spark, sf):
    """Rules given as SQL text and as a Column, over a join."""
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    book = [rules.Rule("ship_before_order", "l_shipdate < o_orderdate"), rules.Rule("large_discount", F.col("l_discount") * F.col("l_extendedprice") > 5000)]
    return rules.evaluate(joined, book).select("rule_name", "failed_count", "total_count")


# Keys. All parents are looked at; those of customers in debt, of small orders and so on have a key that no child refers to,
# so that orphans exist.
IN_CREDIT = "CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -1 - c_custkey END"
SIZED = "CASE WHEN o_totalprice > 100000 THEN o_orderkey ELSE -1 - o_orderkey END"
PENDING = "CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE -1 - o_custkey END"
BIG = "CASE WHEN o_totalprice > 400000 THEN o_custkey ELSE -1 - o_custkey END"


@query(
    "fk_resolve",
    f"SELECT l_orderkey, l_linenumber, l_partkey, o_custkey AS customer_id FROM lineitem LEFT JOIN (SELECT {SIZED} AS k, o_custkey FROM orders) AS o ON l_orderkey = k",
)
def fk_resolve(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parents = table(spark, sf, "orders").select(F.expr(SIZED).alias("l_orderkey"), F.col("o_custkey").alias("customer_id"))
    return keys.resolve(lines, parents, "l_orderkey", "customer_id", ["customer_id"])


@query(
    "fk_resolve_last",
    """SELECT c_custkey, last_order FROM (SELECT CASE WHEN c_acctbal < 1000 THEN NULL ELSE c_custkey END AS c_custkey FROM customer)
    LEFT JOIN (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
)
def fk_resolve_last(spark, sf):
    """The last duplicate of the look-up wins; missing keys match nothing."""
    people = table(spark, sf, "customer").select(F.when(F.col("c_acctbal") >= 1000, F.col("c_custkey")).alias("c_custkey"), F.col("c_acctbal"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"), "o_orderdate")
    return keys.resolve(people, orders, "c_custkey", "last_order", ["o_orderdate", "last_order"]).select("c_custkey", "last_order")


_CONSISTENCY = """SELECT total_rows, matched_rows, total_rows - matched_rows AS unmatched_rows, round(matched_rows * 100e0 / total_rows, 6) AS match_rate,
    CASE WHEN total_rows - matched_rows < total_rows * 0.1 THEN 'PASS' ELSE 'WARN' END AS status FROM ({inner}) AS c"""


@query(
    "fk_consistency",
    _CONSISTENCY.format(inner=f"SELECT count(o_custkey) AS total_rows, count(k) AS matched_rows FROM orders LEFT JOIN (SELECT {IN_CREDIT} AS k FROM customer) AS c ON o_custkey = k"),
)
def fk_consistency(spark, sf):
    parents = table(spark, sf, "customer").select(F.expr(IN_CREDIT).alias("c_custkey"))
    return rounded(keys.consistency(table(spark, sf, "orders"), parents, "o_custkey", "c_custkey"))


@query(
    "fk_consistency_copies",
    _CONSISTENCY.format(inner=f"SELECT count(l_suppkey) AS total_rows, count(k) AS matched_rows FROM lineitem LEFT JOIN (SELECT {PENDING} AS k FROM orders) AS o ON l_suppkey = k"),
)
def fk_consistency_copies(spark, sf):
    """Copies on the parent side multiply rows, as a left join does."""
    parents = table(spark, sf, "orders").select(F.expr(PENDING).alias("o_custkey"))
    return rounded(keys.consistency(table(spark, sf, "lineitem"), parents, "l_suppkey", "o_custkey"))


@query(
    "coverage",
    f"""SELECT count(DISTINCT c_custkey) AS total_parents, count(DISTINCT k) AS parents_with_children,
    round(count(DISTINCT k) * 100e0 / count(DISTINCT c_custkey), 6) AS coverage FROM customer LEFT JOIN (SELECT {BIG} AS k FROM orders) AS o ON c_custkey = k""",
)
def coverage(spark, sf):
    big = table(spark, sf, "orders").select(F.expr(BIG).alias("o_custkey"))
    return rounded(keys.coverage(table(spark, sf, "customer"), big, "c_custkey", "o_custkey"))


@query(
    "fk_orphans",
    f"SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE {IN_CREDIT} = o_custkey)",
)
def fk_orphans(spark, sf):
    parents = table(spark, sf, "customer").select(F.expr(IN_CREDIT).alias("c_custkey"))
    return keys.orphans(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), parents, "o_custkey", "c_custkey")


@query(
    "fk_matched",
    f"SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE {IN_CREDIT} = o_custkey)",
)
def fk_matched(spark, sf):
    parents = table(spark, sf, "customer").select(F.expr(IN_CREDIT).alias("c_custkey"))
    return keys.with_parent(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), parents, "o_custkey", "c_custkey")


# Whole tables again: registrations of customers with a small balance are known to the first master alone.
LEFT_SITES = "SELECT CASE WHEN c_acctbal > 2000 THEN c_custkey ELSE -1 - c_custkey END AS registry_id, c_name AS facility_name, CAST(NULL AS STRING) AS city, c_acctbal / 100e0 AS latitude FROM customer"
RIGHT_SITES = "SELECT s_suppkey AS registry_id, s_name AS facility_name, 'CITY ' || CAST(s_nationkey AS STRING) AS city, CAST(NULL AS DOUBLE) AS latitude FROM supplier"


@query(
    "facility_merge",
    cte(a=LEFT_SITES, b=RIGHT_SITES)
    + """SELECT coalesce(a.registry_id, b.registry_id) AS registry_id, coalesce(a.facility_name, b.facility_name) AS facility_name,
    coalesce(a.city, b.city) AS city, coalesce(a.latitude, b.latitude) AS latitude,
    CASE WHEN a.registry_id IS NULL THEN 'second' WHEN b.registry_id IS NULL THEN 'first' ELSE 'both' END AS found_in
    FROM a FULL OUTER JOIN b ON a.registry_id = b.registry_id""",
)
def facility_merge(spark, sf):
    return matching.merge_masters(frame(spark, sf, LEFT_SITES), frame(spark, sf, RIGHT_SITES), ["registry_id"])


# Positions on a coarse grid, so that neighbours exist; two names per customer that differ by a suffix.
SITES = """
SELECT c_custkey AS id, 'PLANT ' || c_mktsegment || ' ' || CAST(c_nationkey AS STRING) AS name, 'STREET ' || CAST(c_nationkey AS STRING) AS address,
       CASE WHEN c_nationkey < 12 THEN 'CA' ELSE 'TX' END AS state, floor(c_acctbal / 50e0) * 0.004e0 AS latitude, c_nationkey * 0.006e0 AS longitude FROM customer
"""
OTHER_SITES = """
SELECT s_suppkey AS id, 'PLANT ' || CASE WHEN s_acctbal > 5000 THEN 'BUILDING' ELSE 'MACHINERIE' END || ' ' || CAST(s_nationkey AS STRING) AS name,
       'STREET ' || CAST(s_nationkey AS STRING) || 'A' AS address, CASE WHEN s_nationkey < 12 THEN 'CA' ELSE 'TX' END AS state,
       floor(s_acctbal / 50e0) * 0.004e0 AS latitude, s_nationkey * 0.006e0 AS longitude FROM supplier
"""


@query(
    "facility_match",
    cte(a=SITES, b=OTHER_SITES)
    + """, x AS (SELECT min(id) AS id, count(*) AS copies, name, address, state, latitude, longitude FROM a GROUP BY ALL), y AS (SELECT min(id) AS id, count(*) AS copies, name, address, state, latitude, longitude FROM b GROUP BY ALL),
    p AS (SELECT a.id AS left_id, b.id AS right_id, a.copies AS left_copies, b.copies AS right_copies,
      1e0 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE) AS name_similarity,
      1e0 - levenshtein(a.address, b.address) / CAST(greatest(length(a.address), length(b.address)) AS DOUBLE) AS address_similarity
      FROM x AS a JOIN y AS b ON a.state = b.state AND abs(a.latitude - b.latitude) <= 0.01e0 AND abs(a.longitude - b.longitude) <= 0.01e0)
    SELECT left_id, right_id, left_copies, right_copies, round(name_similarity, 6) AS name_similarity, round(address_similarity, 6) AS address_similarity
    FROM p WHERE name_similarity >= 0.85e0 AND address_similarity >= 0.8e0""",
)
def facility_match(spark, sf):
    return rounded(matching.match_sites(frame(spark, sf, SITES), frame(spark, sf, OTHER_SITES)))


@query("site_members", cte(a=SITES) + "SELECT id, min(id) OVER (PARTITION BY name, address, state, latitude, longitude) AS site_id FROM a")
def site_members(spark, sf):
    return matching.site_members(frame(spark, sf, SITES))


# Scores


@query(
    "column_completeness",
    cte(e=EMISSIONS)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) AS total_records, round(count({c}) * 100e0 / count(*), 6) AS completeness FROM e"
        for c in ("facility_id", "registry_id", "reporting_year", "pollutant_name", "annual_emission_amount", "unit_of_measure", "program_system_acronym", "l_orderkey", "l_linenumber", "l_partkey")
    ),
)
def column_completeness(spark, sf):
    return rounded(scores.column_completeness(frame(spark, sf, EMISSIONS)))


@query(
    "completeness",
    cte(e=EMISSIONS)
    + """SELECT count(*) AS total_records, count(*) FILTER (WHERE pollutant_name IS NOT NULL AND annual_emission_amount IS NOT NULL) AS complete_records,
    round((count(pollutant_name) * 100e0 / count(*) + count(annual_emission_amount) * 100e0 / count(*)) / 2, 6) AS completeness_score FROM e""",
)
def completeness(spark, sf):
    return rounded(scores.completeness(frame(spark, sf, EMISSIONS), ["pollutant_name", "annual_emission_amount"]))


@query(
    "accuracy",
    cte(e=EMISSIONS)
    + """SELECT count(*) AS total_records, count(*) FILTER (WHERE annual_emission_amount IS NOT NULL) AS valid_records,
    round(count(*) FILTER (WHERE annual_emission_amount IS NOT NULL) * 100e0 / count(*), 6) AS accuracy_score FROM e""",
)
def accuracy(spark, sf):
    return rounded(scores.accuracy(frame(spark, sf, EMISSIONS)))


@query(
    "accuracy_of_rules",
    cte(f=FACILITIES)
    + f", r AS ({rules_sql('f', FACILITY_CHECKS)}) "
    + """SELECT max(total_count) AS total_records, CAST(max(total_count) - floor(sum(failed_count) / count(*)) AS BIGINT) AS valid_records,
    round((sum(total_count) - sum(failed_count)) * 100e0 / sum(total_count), 6) AS accuracy_score FROM r""",
)
def accuracy_of_rules(spark, sf):
    return rounded(scores.accuracy_of_rules(results_of(spark, sf, FACILITIES, "facilities")))


@query(
    "consistency",
    cte(f=FACILITIES)
    + """, v AS (SELECT count(*) AS n, count(*) FILTER (WHERE (latitude IS NULL) <> (longitude IS NULL)) + count(*) FILTER (WHERE state_code <> upper(state_code)) AS bad FROM f)
    SELECT n AS total_records, bad AS consistency_violations, greatest(0, n - bad) AS consistent_records, round(greatest(0, n - bad) * 100e0 / n, 6) AS consistency_score FROM v""",
)
def consistency(spark, sf):
    return rounded(scores.consistency(frame(spark, sf, FACILITIES)))


MIXED_DATES = """
SELECT o_orderkey, o_totalprice, o_totalprice * (CASE o_orderpriority WHEN '1-URGENT' THEN 0.9e0 ELSE 1.1e0 END) AS ceiling,
       CASE WHEN o_orderstatus = 'O' THEN '01/02/2024' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS stamped FROM orders
"""


@query(
    "consistency_custom",
    cte(t=MIXED_DATES)
    + """, s AS (SELECT CASE WHEN regexp_matches(stamped, '^\\d{4}-') THEN 'iso' ELSE 'us' END AS shape, count(*) AS n FROM t WHERE stamped IS NOT NULL GROUP BY 1),
    v AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice >= ceiling) + count(*) - (SELECT max(n) FROM s) AS bad FROM t)
    SELECT n AS total_records, bad AS consistency_violations, greatest(0, n - bad) AS consistent_records, round(greatest(0, n - bad) * 100e0 / n, 6) AS consistency_score FROM v""",
)
def consistency_custom(spark, sf):
    """A cross-field rule and a format rule."""
    rows = frame(spark, sf, MIXED_DATES)
    return rounded(scores.consistency(rows, [scores.crossed("o_totalprice", "ceiling"), scores.mixed_formats("stamped")]))


@query(
    "uniqueness",
    """SELECT n AS total_records, u AS unique_records, round(u * 100e0 / n, 6) AS uniqueness_score, n - u AS duplicate_count
    FROM (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, nullif(l_linenumber, 3) FROM lineitem)) AS u FROM lineitem) AS t""",
)
def uniqueness(spark, sf):
    """Null parts of a key count as values."""
    lines = table(spark, sf, "lineitem").withColumn("line", F.nullif(F.col("l_linenumber"), F.lit(3)))
    return rounded(scores.uniqueness(lines, ["l_orderkey", "line"]))


@query(
    "row_uniqueness",
    """SELECT n AS total_records, u AS unique_records, round(u * 100e0 / n, 6) AS uniqueness_score, n - u AS duplicate_count
    FROM (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS u FROM lineitem) AS t""",
)
def row_uniqueness(spark, sf):
    return rounded(scores.uniqueness(table(spark, sf, "lineitem")))


@query(
    "timeliness",
    """SELECT count(*) AS total_records, count(*) FILTER (WHERE epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) <= 10 * 86400000000) AS current_records,
    round(count(*) FILTER (WHERE epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) <= 10 * 86400000000) * 100e0 / count(ts), 6) AS timeliness_score,
    round(avg(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000)), 6) AS avg_data_age_days FROM events""",
)
def timeliness(spark, sf):
    return rounded(scores.timeliness(table(spark, sf, "events"), AS_OF, ["ts"], days=10))


LATE = datetime(1998, 12, 1)


@query(
    "timeliness_two_dates",
    """WITH seen AS (SELECT greatest(l_shipdate, CASE WHEN l_returnflag = 'R' THEN l_shipdate + l_linenumber * INTERVAL 30 DAY END) AS t FROM lineitem),
    aged AS (SELECT t, epoch_us(TIMESTAMP '1998-12-01') - epoch_us(t) AS age FROM seen)
    SELECT count(*) AS total_records, count(*) FILTER (WHERE age <= 1000 * 86400000000) AS current_records,
    round(count(*) FILTER (WHERE age <= 1000 * 86400000000) * 100e0 / count(t), 6) AS timeliness_score, round(avg(floor(age / 86400000000)), 6) AS avg_data_age_days FROM aged""",
)
def timeliness_two_dates(spark, sf):
    """Of two dates of a row, here those of shipping and of a return, the newest counts."""
    back = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber") * 30))
    return rounded(scores.timeliness(table(spark, sf, "lineitem").withColumn("return_date", back), LATE, ["l_shipdate", "return_date"], days=1000))


_SCORED = (
    "facility_id", "registry_id", "reporting_year", "pollutant_name", "annual_emission_amount", "unit_of_measure", "program_system_acronym", "l_orderkey", "l_linenumber", "l_partkey",
)
_TEXT = ("registry_id", "pollutant_name", "unit_of_measure", "program_system_acronym")


@query(
    "column_scores",
    cte(e=EMISSIONS)
    + ", s AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) * 100e0 / count(*) AS c, "
        + (f"count(*) FILTER (WHERE length(trim({c})) > 0) * 100e0 / count({c})" if c in _TEXT else "100e0")
        + f" AS v, count(DISTINCT {c}) * 100e0 / count(*) AS u FROM e"
        for c in _SCORED
    )
    + ") SELECT column_name, round(c, 6) AS completeness, round(v, 6) AS validity, round(u, 6) AS uniqueness, round(least(100e0, c * 0.4e0 + v * 0.4e0 + u * 0.2e0), 6) AS column_score FROM s",
)
def column_scores(spark, sf):
    return rounded(scores.column_scores(frame(spark, sf, EMISSIONS)))


_GRADE = "CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 60 THEN 'D' ELSE 'F' END"
QUALITY_SQL = """SELECT {name} AS dataset_name, count(*) AS n,
    count(*) FILTER (WHERE registry_id IS NOT NULL AND facility_name IS NOT NULL AND latitude IS NOT NULL) AS complete,
    (count(registry_id) + count(facility_name) + count(latitude)) * 100e0 / count(*) / 3 AS c,
    count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS valid,
    count(*) FILTER (WHERE (latitude IS NULL) <> (longitude IS NULL)) + count(*) FILTER (WHERE state_code <> upper(state_code)) AS bad,
    count(DISTINCT npdes_id) AS u FROM {frame}"""


@query(
    "quality_grade",
    cte(f=FACILITIES)
    + f", q AS ({QUALITY_SQL.format(name=repr('facilities'), frame='f')}), "
    + """s AS (SELECT *, valid * 100e0 / n AS a, (n - bad) * 100e0 / n AS k, u * 100e0 / n AS q, c * 0.25e0 + valid * 100e0 / n * 0.3e0
    + (n - bad) * 100e0 / n * 0.2e0 + u * 100e0 / n * 0.15e0 + 100e0 * 0.1e0 AS total FROM q)
    SELECT dataset_name, n AS total_records, complete AS complete_records, round(c, 6) AS completeness_score, valid AS valid_records, round(a, 6) AS accuracy_score,
    n - bad AS consistent_records, round(k, 6) AS consistency_score, u AS unique_records, round(s.q, 6) AS uniqueness_score, n AS current_records,
    100e0 AS timeliness_score, round(total, 6) AS overall_quality_score, """
    + _GRADE
    + " AS quality_grade FROM s",
)
def quality_grade(spark, sf):
    return rounded(scores.quality(frame(spark, sf, FACILITIES), "facilities", AS_OF, ["registry_id", "facility_name", "latitude"], ["npdes_id"]))


def quality_by_dataset(spark, sf):
    """Scores of three data sets."""
    frames = {"facilities": (FACILITIES, ["npdes_id"]), "permits": (PERMITS, ["permit_id"]), "air_emissions": (EMISSIONS, ["registry_id", "reporting_year", "l_orderkey"])}
    parts = [scores.quality(frame(spark, sf, text), name, AS_OF, keys=key) for name, (text, key) in frames.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def scores_sql(name: str, text: str, completeness: str, valid: str, bad: str, key: str, rows: str = "true", timely: str = "100e0") -> str:
    """Dimension scores of a frame; without a date column everything is current."""
    return f"""SELECT '{name}' AS dataset_name, c AS completeness, a AS accuracy, k AS consistency, u AS uniqueness, t AS timeliness, c * 0.25e0 + a * 0.3e0 + k * 0.2e0 + u * 0.15e0 + t * 0.1e0 AS total
      FROM (SELECT {timely} AS t, {completeness} AS c, count(*) FILTER (WHERE {valid}) * 100e0 / count(*) AS a, (count(*) - ({bad})) * 100e0 / count(*) AS k, count(DISTINCT {key}) * 100e0 / count(*) AS u FROM ({text}) AS f WHERE {rows}) AS q"""


def mean_filled(columns) -> str:
    return "(" + " + ".join(f"count({c})" for c in columns) + f") * 100e0 / count(*) / {len(columns)}"


FACILITY_COLUMNS = (
    "facility_id", "registry_id", "facility_name", "state_code", "latitude", "longitude", "epa_region", "annual_emission_amount", "ph_level", "measurement_year", "npdes_id",
    "compliance_violations", "violation_count", "inspection_count", "compliance_status", "penalty_amount", "data_quality_score",
)
_BAD_FACILITY = "count(*) FILTER (WHERE (latitude IS NULL) <> (longitude IS NULL)) + count(*) FILTER (WHERE state_code <> upper(state_code))"
_VALID_FACILITY = "latitude IS NOT NULL AND longitude IS NOT NULL"
_BEFORE = scores_sql("facilities", FACILITIES, mean_filled(FACILITY_COLUMNS), _VALID_FACILITY, _BAD_FACILITY, "facility_id")
_AFTER = scores_sql("facilities", FACILITIES, mean_filled(FACILITY_COLUMNS), _VALID_FACILITY, _BAD_FACILITY, "facility_id", "latitude IS NOT NULL AND longitude IS NOT NULL AND facility_name IS NOT NULL")
_LETTER = "CASE WHEN total >= 90 THEN 5 WHEN total >= 80 THEN 4 WHEN total >= 70 THEN 3 WHEN total >= 60 THEN 2 ELSE 1 END"
_IMPROVED = f"WITH b AS (SELECT *, {_LETTER} AS grade FROM ({_BEFORE}) AS x), a AS (SELECT *, {_LETTER} AS grade FROM ({_AFTER}) AS y) " + " UNION ALL ".join(
    f"""SELECT b.dataset_name, substr('FDCBA', b.grade, 1) AS grade_before, substr('FDCBA', a.grade, 1) AS grade_after, a.grade > b.grade AS grade_improved, (a.total - b.total) / b.total * 100 >= 42 AS target_met,
    '{d}' AS dimension, round(a.{c} - b.{c}, 6) AS absolute_gain, round((a.{c} - b.{c}) / b.{c} * 100, 6) AS percent_gain FROM b CROSS JOIN a"""
    for d, c in (("completeness", "completeness"), ("accuracy", "accuracy"), ("consistency", "consistency"), ("uniqueness", "uniqueness"), ("timeliness", "timeliness"), ("overall", "total"))
)


@query("quality_improvement", _IMPROVED)
def quality_improvement(spark, sf):
    """Facilities before and after bad coordinates and names are dropped."""
    rows = frame(spark, sf, FACILITIES)
    before = scores.quality(rows, "facilities", AS_OF, keys=["facility_id"])
    after = scores.quality(rows.filter("latitude is not null and longitude is not null and facility_name is not null"), "facilities", AS_OF, keys=["facility_id"])
    return rounded(scores.improvement(before, after))


_PERMIT_COLUMNS = (
    "permit_id", "facility_id", "npdes_id", "external_permit_number", "permit_type_code", "permit_status_code", "major_minor_status", "total_design_flow_mgd", "actual_average_flow_mgd", "effective_date", "expiration_date",
)
_EMISSION_COLUMNS = ("facility_id", "registry_id", "reporting_year", "pollutant_name", "annual_emission_amount", "unit_of_measure", "program_system_acronym", "l_orderkey", "l_linenumber", "l_partkey")
_BY_DATASET = " UNION ALL ".join(
    (
        scores_sql("facilities", FACILITIES, mean_filled(FACILITY_COLUMNS), _VALID_FACILITY, _BAD_FACILITY, "npdes_id"),
        scores_sql(
            "permits", PERMITS, mean_filled(_PERMIT_COLUMNS), "total_design_flow_mgd IS NOT NULL AND actual_average_flow_mgd IS NOT NULL", "0", "permit_id",
            timely="count(*) FILTER (WHERE effective_date >= DATE '2024-01-01') * 100e0 / count(effective_date)",
        ),
        scores_sql("air_emissions", EMISSIONS, mean_filled(_EMISSION_COLUMNS), "annual_emission_amount IS NOT NULL", "0", "(registry_id, reporting_year, l_orderkey)"),
    )
)


@query("grade_histogram", f"SELECT substr('FDCBA', {_LETTER}, 1) AS quality_grade, count(*) AS datasets, round(avg(total), 6) AS average_quality_score FROM ({_BY_DATASET}) AS s GROUP BY 1")
def grade_histogram(spark, sf):
    return rounded(scores.grade_histogram(quality_by_dataset(spark, sf)))


@query(
    "score_history",
    f"""SELECT '2024-01-31' AS measured_at, dataset_name, round(total, 6) AS overall_quality_score, round(completeness, 6) AS completeness_score, round(accuracy, 6) AS accuracy_score,
    round(consistency, 6) AS consistency_score FROM ({_BY_DATASET}) AS s""",
)
def score_history(spark, sf):
    return rounded(scores.score_history(quality_by_dataset(spark, sf).withColumn("measured_at", F.lit("2024-01-31")), "measured_at"))


@query(
    "weighted_check",
    cte(f=FACILITIES)
    + """, s AS (SELECT (count(registry_id) + count(facility_name) + count(latitude)) * 100e0 / count(*) / 3 AS completeness,
      (count(*) FILTER (WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) * 100e0 / count(*) + count(*) FILTER (WHERE epa_region BETWEEN 1 AND 10) * 100e0 / count(*)) / 2 AS validity,
      count(*) FILTER (WHERE compliance_violations > 0 AND inspection_count > 0) * 100e0 / count(*) FILTER (WHERE compliance_violations > 0) AS consistency FROM f),
    t AS (SELECT *, completeness * 0.4e0 + validity * 0.4e0 + consistency * 0.2e0 AS total FROM s)
    SELECT round(completeness, 6) AS completeness, round(validity, 6) AS validity, round(consistency, 6) AS consistency, round(total, 6) AS overall_quality,
      CASE WHEN total >= 95 THEN 'A+' WHEN total >= 90 THEN 'A' WHEN total >= 85 THEN 'B+' WHEN total >= 80 THEN 'B' WHEN total >= 75 THEN 'C+' WHEN total >= 70 THEN 'C' ELSE 'D' END AS grade FROM t""",
)
def weighted_check(spark, sf):
    valid = [F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.col("epa_region").between(1, 10)]
    row = scores.weighted_check(
        frame(spark, sf, FACILITIES), ["registry_id", "facility_name", "latitude"], valid, F.col("compliance_violations") > 0, F.col("inspection_count") > 0
    )
    return rounded(row)


_PROFILED = (
    "facility_id", "registry_id", "facility_name", "state_code", "latitude", "longitude", "epa_region", "annual_emission_amount", "ph_level", "measurement_year", "npdes_id",
    "compliance_violations", "violation_count", "inspection_count", "compliance_status", "penalty_amount", "data_quality_score",
)


@query(
    "profile",
    cte(f=FACILITIES)
    + f"""SELECT 'facilities' AS dataset_name, count(*) AS row_count, CAST(17 AS BIGINT) AS column_count, CAST(12 AS BIGINT) AS numeric_columns, CAST(5 AS BIGINT) AS text_columns,
    round((17 * count(*) - {" - ".join(f"count({c})" for c in _PROFILED)}) * 100e0 / (17 * count(*)), 6) AS missing_percentage, '' AS sparse_columns FROM f
    UNION ALL SELECT 'sparse', count(*), 2, 1, 1, round((2 * count(*) - count(c_custkey) - count(CASE WHEN c_acctbal > 6000 THEN c_name END)) * 100e0 / (2 * count(*)), 6), 'name' FROM customer""",
)
def profiles(spark, sf):
    facilities = frame(spark, sf, FACILITIES)
    sparse = frame(spark, sf, "SELECT c_custkey, CASE WHEN c_acctbal > 6000 THEN c_name END AS name FROM customer")
    return rounded(profile.profile_all({"facilities": facilities, "sparse": sparse}))


@query(
    "profile_totals",
    """SELECT count(*) AS datasets, CAST(sum(c) AS BIGINT) AS total_columns, CAST(sum(n) AS BIGINT) AS total_rows, 0e0 AS average_missing_percentage FROM (
    SELECT 6 AS c, count(*) AS n FROM orders UNION ALL SELECT 11, count(*) FROM lineitem UNION ALL SELECT 6, count(*) FROM events) AS t""",
)
def profile_totals(spark, sf):
    return rounded(profile.totals(profile.profile_all({n: table(spark, sf, n) for n in ("orders", "lineitem", "events")})))


# Load checks


def integrity_sql(frame_name: str, label: str, columns: list[str], key: str, required: list[str], lat: str | None, lon: str | None) -> str:
    nulls = " AND ".join(f"{c} IS NULL" for c in columns)
    parts = [("null_rows", f"count(*) FILTER (WHERE {nulls})", "WARN"), ("primary_key_duplicates", f"count({key}) - count(DISTINCT {key})", "FAIL")]
    parts += [(f"missing_{c}", f"count(*) FILTER (WHERE {c} IS NULL)", "WARN") for c in required]
    if lat:
        parts += [("invalid_latitude", f"count(*) FILTER (WHERE {lat} < -90 OR {lat} > 90)", "FAIL"), ("invalid_longitude", f"count(*) FILTER (WHERE {lon} < -180 OR {lon} > 180)", "FAIL")]
    rows = [f"SELECT '{label}' AS table_name, '{n}' AS check_name, CAST({c} AS DOUBLE) AS value, CASE WHEN {c} = 0 THEN 'PASS' ELSE '{w}' END AS status FROM {frame_name}" for n, c, w in parts]
    filled = "(" + " + ".join(f"count({c})" for c in columns) + f") * 100e0 / count(*) / {len(columns)}"
    rows.append(f"SELECT '{label}', 'average_completeness', round({filled}, 6), CASE WHEN {filled} >= 80 THEN 'PASS' ELSE 'WARN' END FROM {frame_name}")
    return " UNION ALL ".join(rows)


CHECKED_COLUMNS = (
    "facility_id registry_id facility_name state_code latitude longitude epa_region annual_emission_amount ph_level measurement_year npdes_id compliance_violations "
    "violation_count inspection_count compliance_status penalty_amount data_quality_score"
).split()
EMISSION_COLUMNS = "facility_id registry_id reporting_year pollutant_name annual_emission_amount unit_of_measure program_system_acronym l_orderkey l_linenumber l_partkey".split()
_FACILITY_CHECK = integrity_sql("f", "facilities", CHECKED_COLUMNS, "facility_id", ["facility_name", "state_code"], "latitude", "longitude")
_EMISSION_CHECK = integrity_sql("e", "air_emissions", EMISSION_COLUMNS, "l_orderkey", ["registry_id", "reporting_year", "pollutant_name"], None, None)


def load_checks(spark, sf):
    return [
        loadchecks.integrity(frame(spark, sf, FACILITIES), "facilities", "facility_id", ["facility_name", "state_code"], "latitude", "longitude"),
        loadchecks.integrity(frame(spark, sf, EMISSIONS), "air_emissions", "l_orderkey", ["registry_id", "reporting_year", "pollutant_name"]),
    ]


@query("table_integrity", cte(f=FACILITIES, e=EMISSIONS) + _FACILITY_CHECK + " UNION ALL " + _EMISSION_CHECK)
def table_integrity(spark, sf):
    first, second = load_checks(spark, sf)
    return rounded(first.unionByName(second))


@query(
    "load_validation",
    cte(f=FACILITIES, e=EMISSIONS)
    + f", c AS ({_FACILITY_CHECK} UNION ALL {_EMISSION_CHECK} UNION ALL SELECT 'orders_customer', 'unmatched_rows', 0e0, 'PASS') "
    + """SELECT table_name, count(*) AS checks, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warned,
    count(*) FILTER (WHERE status = 'FAIL') AS failed, CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS overall_status FROM c GROUP BY table_name""",
)
def load_validation(spark, sf):
    relation = keys.consistency(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey")
    return loadchecks.roll_up([*load_checks(spark, sf), loadchecks.relationship_check(relation, "orders_customer")])


@query(
    "null_violations",
    cte(e=EMISSIONS)
    + "SELECT 'air_emissions' AS table_name, 'pollutant_name' AS column_name, count(*) AS null_count FROM e WHERE pollutant_name IS NULL UNION ALL SELECT 'air_emissions', 'unit_of_measure', count(*) FROM e WHERE unit_of_measure IS NULL",
)
def null_violations(spark, sf):
    return loadchecks.null_violations(frame(spark, sf, EMISSIONS), "air_emissions", ["registry_id", "pollutant_name", "unit_of_measure", "reporting_year"])


TIMED_RUNS = f"SELECT r.*, ts AS end_time FROM ({RUNS}) AS r"


@query(
    "freshness",
    cte(r=TIMED_RUNS)
    + """SELECT process_name, strftime(max(end_time), '%Y-%m-%d %H:%M:%S.%f') AS last_run, count(*) AS run_count FROM r
    WHERE status = 'SUCCESS' AND end_time >= TIMESTAMP '2024-01-24' GROUP BY process_name""",
)
def freshness(spark, sf):
    fresh = loadchecks.freshness(frame(spark, sf, TIMED_RUNS), AS_OF)
    return fresh.withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "throughput",
    cte(r=RUNS)
    + """, e AS (SELECT *, to_seconds(CAST(floor(duration_seconds) AS INT)) + start_time AS end_time FROM r)
    SELECT process_name, round(avg(records_processed), 4) AS avg_records, round(avg(epoch(end_time) - epoch(start_time)), 4) AS avg_duration_seconds,
    round(avg(records_processed / nullif(floor(duration_seconds), 0)), 4) AS avg_records_per_second, count(*) AS run_count,
    CASE WHEN avg(records_processed / nullif(floor(duration_seconds), 0)) > 1000 THEN 'PASS' ELSE 'WARN' END AS status
    FROM e WHERE status = 'SUCCESS' AND records_processed > 0 AND end_time >= TIMESTAMP '2024-01-11' GROUP BY process_name""",
)
def throughput(spark, sf):
    ended = frame(spark, sf, RUNS).withColumn("end_time", F.timestamp_add("SECOND", F.floor("duration_seconds").cast("int"), F.col("start_time").cast("timestamp")))
    return rounded(loadchecks.throughput(ended, AS_OF, hours=480), 4)


# Named views


@query(
    "named_views",
    cte(p=PERMITS, e=EMISSIONS)
    + """SELECT 'active_permits' AS view_name, count(*) AS row_count FROM p WHERE permit_status_code IN ('ADC', 'EFF') AND (expiration_date IS NULL OR expiration_date >= DATE '2024-01-31')
    UNION ALL SELECT 'recent_emissions', count(*) FROM e WHERE reporting_year >= 2014 - 15
    UNION ALL SELECT 'high_emitters', count(*) FROM e WHERE annual_emission_amount > 1000""",
)
def named_views(spark, sf):
    permits, emissions = frame(spark, sf, PERMITS), frame(spark, sf, EMISSIONS)
    found = {
        "active_permits": views.active_permits(permits, TODAY),
        "recent_emissions": views.recent(emissions, "reporting_year", TODAY, 25),
        "high_emitters": views.high_emitters(emissions),
    }
    counts = [v.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("view_name"), "row_count") for n, v in found.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "period_labels",
    """SELECT CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period, count(*) AS n,
    CAST(sum(date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-01-31')) AS BIGINT) AS age_days FROM orders GROUP BY 1""",
)
def period_labels(spark, sf):
    label = views.period_label(F.year("o_orderdate"), F.quarter("o_orderdate")).alias("period")
    age = views.permit_age_days(F.col("o_orderdate").cast("date"), TODAY)
    return table(spark, sf, "orders").groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(age).alias("age_days"))
