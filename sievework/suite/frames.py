"""Domain-shaped frames as SQL over the given tables.

The texts run unchanged in Spark and in the engine that checks the results: ``1e0`` is a double and
``STRING`` a text in both.  Defects come from the values themselves (a balance out of range becomes an
impossible latitude), for whole tables.
"""

# Two letters per nation key; XX, ZZ and the lower-case code are planted defects.
STATES = "CATXNYFLWAORNVAZcoUTILINOHMIPAVAGAXXZZMNWIKYTNALMS"

FACILITIES = f"""
SELECT c_custkey AS facility_id,
       CASE WHEN c_acctbal < 0 THEN 'INVALID_ID' ELSE CAST(110000000000 + c_custkey AS STRING) END AS registry_id,
       CASE WHEN c_acctbal > 9500 THEN '' WHEN c_acctbal > 9200 THEN NULL
            ELSE c_mktsegment || ' CORP & CO ' || c_name END AS facility_name,
       substr('{STATES}', c_nationkey * 2 + 1, 2) AS state_code,
       CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 8000 THEN NULL
            WHEN c_mktsegment = 'FURNITURE' THEN floor(c_acctbal / 100e0) * 1e0
            ELSE c_acctbal / 100e0 END AS latitude,
       CASE WHEN c_nationkey = 24 THEN NULL ELSE c_nationkey * 15e0 - 185e0 END AS longitude,
       c_nationkey - 3 AS epa_region,
       CASE WHEN c_acctbal < 500 THEN 0e0 ELSE c_acctbal * 150000e0 END AS annual_emission_amount,
       c_acctbal / 600e0 AS ph_level,
       1990 + c_nationkey * 2 AS measurement_year,
       CASE WHEN c_acctbal > 9000 THEN '' WHEN c_mktsegment = 'BUILDING' THEN 'BAD_' || CAST(c_custkey AS STRING)
            ELSE 'AK' || CAST(c_custkey AS STRING) END AS npdes_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN -1 WHEN 'AUTOMOBILE' THEN 3 WHEN 'MACHINERY' THEN 1 ELSE 0 END AS compliance_violations,
       CASE c_mktsegment WHEN 'BUILDING' THEN -1 WHEN 'AUTOMOBILE' THEN 3 WHEN 'MACHINERY' THEN 1 ELSE 0 END AS violation_count,
       CASE WHEN c_nationkey < 8 THEN 0 ELSE c_nationkey END AS inspection_count,
       CASE WHEN c_nationkey < 5 THEN 'Compliant' WHEN c_nationkey < 10 THEN 'SNC' WHEN c_nationkey < 20 THEN 'good' END AS compliance_status,
       c_acctbal * 150e0 AS penalty_amount,
       greatest(0e0, least(100e0, c_acctbal / 90e0)) AS data_quality_score
FROM customer
"""

PERMITS = """
SELECT o_orderkey AS permit_id, o_custkey AS facility_id,
       CASE WHEN o_totalprice < 5000 THEN NULL ELSE 'AK' || CAST(o_custkey AS STRING) END AS npdes_id,
       'P' || CAST(o_orderkey AS STRING) AS external_permit_number,
       CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN ' ' ELSE o_orderpriority END AS permit_type_code,
       CASE o_orderstatus WHEN 'O' THEN 'EFF' WHEN 'F' THEN 'EXP' ELSE 'OLD' END AS permit_status_code,
       CASE o_orderstatus WHEN 'O' THEN 'Major' WHEN 'F' THEN 'N' ELSE 'X' END AS major_minor_status,
       o_totalprice / 40e0 AS total_design_flow_mgd,
       CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 30e0 ELSE o_totalprice / 50e0 - 100e0 END AS actual_average_flow_mgd,
       CAST(o_orderdate AS DATE) AS effective_date,
       CASE WHEN o_orderpriority = '2-HIGH' THEN DATE '1996-06-30'
            WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE DATE '2024-06-30' END AS expiration_date
FROM orders
"""

EMISSIONS = """
SELECT l_suppkey AS facility_id, CAST(110000000000 + l_partkey AS STRING) AS registry_id,
       CAST(year(l_shipdate) AS INT) AS reporting_year,
       CASE WHEN l_quantity = 13 THEN NULL WHEN l_quantity = 14 THEN ' ' ELSE 'POLLUTANT ' || l_returnflag END AS pollutant_name,
       CASE WHEN l_discount = 0.0 THEN NULL WHEN l_discount = 0.01 THEN -l_extendedprice
            WHEN l_discount = 0.02 THEN l_extendedprice * 100000e0 ELSE l_extendedprice END AS annual_emission_amount,
       CASE WHEN l_tax = 0.0 THEN 'lbs' WHEN l_tax = 0.01 THEN 'Tons' WHEN l_tax = 0.02 THEN 'kg'
            WHEN l_tax = 0.03 THEN 'GRAMS' WHEN l_tax = 0.04 THEN 'Short Tons' WHEN l_tax = 0.05 THEN 'Metric Tons'
            WHEN l_tax = 0.06 THEN 'barrels' END AS unit_of_measure,
       l_linestatus AS program_system_acronym, l_orderkey, l_linenumber, l_partkey
FROM lineitem
"""

# Row number within equal keys would differ between engines; all columns together are the order.
MEASUREMENTS = """
SELECT event_id, 'AK' || CAST(user_id AS STRING) AS npdes_id,
       CASE event_type WHEN 'error' THEN '20240' WHEN 'click' THEN '20231' WHEN 'view' THEN '1969' || '2'
            WHEN 'purchase' THEN '20304' ELSE '20243' END AS yearqtr,
       CASE WHEN value > 100 THEN 'S' WHEN value > 60 THEN ' ' WHEN value > 30 THEN 'Q' ELSE 'E' END AS hlrnc,
       CAST(floor(value / 25e0) AS INT) AS nume90_q,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value / 60e0) AS INT) END AS numcvdt,
       CAST(floor(value / 90e0) AS INT) AS numpsch,
       CAST(floor(value * 4e0) AS INT) - 20 AS numsvcd
FROM events
"""

# Events as a run log: one run per event, the value is its duration in seconds.
RUNS = """
SELECT event_id AS batch_id, event_type AS process_name, ts AS start_time, ts AS ts,
       CASE WHEN event_type = 'error' THEN 'FAILED' WHEN value < 5 THEN 'RUNNING' ELSE 'SUCCESS' END AS status,
       value AS duration_seconds, CAST(floor(value * 900e0) AS BIGINT) AS records_processed,
       CASE WHEN value < 1 THEN 0e0 ELSE floor(value * 900e0) / (value + 10e0) END AS records_per_second,
       value * 2e0 + 100e0 AS average_memory_mb, least(100e0, value) AS average_cpu_percent, user_id
FROM events
"""


def cte(**frames: str) -> str:
    """``WITH`` clause naming the given texts."""
    return "WITH " + ", ".join(f"{name} AS ({text})" for name, text in frames.items()) + "\n"
