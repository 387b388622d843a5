"""Named subsets of the core tables, and the label expressions that go with them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import codes

HIGH_EMISSION_ABOVE = 1000.0


def active_permits(permits: DataFrame, as_of: date) -> DataFrame:
    open_ended = F.col("expiration_date").isNull() | (F.col("expiration_date") >= F.lit(as_of))
    return permits.filter(F.col("permit_status_code").isin(*codes.ACTIVE_PERMIT_CODES) & open_ended)


def recent(df: DataFrame, year_column: str, as_of: date, years: int) -> DataFrame:
    """Rows of the last ``years`` years; with a table partitioned by year this prunes folders."""
    return df.filter(F.col(year_column) >= as_of.year - years)


def high_emitters(emissions: DataFrame) -> DataFrame:
    return emissions.filter(F.col("annual_emission_amount") > HIGH_EMISSION_ABOVE)


def with_violations(measurements: DataFrame) -> DataFrame:
    counts = ("effluent_violations_90day", "compliance_violations", "schedule_violations")
    return measurements.filter(" OR ".join(f"{c} > 0" for c in counts))


def noncompliant(history: DataFrame) -> DataFrame:
    return history.filter(F.col("has_significant_noncompliance"))


def penalised(history: DataFrame) -> DataFrame:
    return history.filter(F.col("total_penalties") > 0)


def open_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("resolution_status") == "OPEN")


def period_label(year: Column, quarter: Column) -> Column:
    """``2024Q3``."""
    return F.concat(year.cast("string"), F.lit("Q"), quarter.cast("string"))


def permit_age_days(effective: Column, as_of: date) -> Column:
    return F.date_diff(F.lit(as_of), effective)
