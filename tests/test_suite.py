"""The registered queries: contract, and agreement with their SQL on the smallest tables.

``check.py`` compares all of them; here one or two per family keep the run short.
"""

import pytest

import __spark_entry__ as contract
from check import compare, connect
from conftest import SMALL

SHOWN = (
    "flexible_dates", "name_clean", "dedup_keep_first", "compliance_score", "unit_normalise", "row_quality", "transform_measurements", "correction_counts", "rule_results", "facility_rules", "permit_rules",
    "sample_failures", "user_rules", "fk_resolve", "fk_consistency", "fk_orphans", "coverage", "facility_match", "column_scores", "quality_grade", "timeliness", "profile", "load_validation", "zscore", "iqr",
    "modified_z_long_column", "trend_change", "yearly_spike", "dbscan_noise", "trend_fit", "findings", "stage_statistics", "checkpoint", "executive_summary", "facility_ranking", "recent_trend", "sla_windows",
    "health_score", "task_rollup", "run_log", "csv_extract", "staging_write_read", "upsert_partitions", "core_load", "stream_sla_windows", "stream_dedup", "stream_ingest",
)


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


def test_contract(spark):
    known, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(known) and set(SHOWN) <= set(sql) and len(known) > 140
    assert contract.entry(spark).count() > 5


@pytest.mark.parametrize("name", SHOWN)
def test_agrees_with_sql(spark, database, name):
    assert compare(contract.queries()[name](spark, SMALL), database, contract.oracle_sql()[name]) == ""
