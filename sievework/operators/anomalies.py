"""All anomaly checks of a table as one list of summary rows, and the roll-up over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.scoring import share
from sievework.functions.text import has_token
from sievework.operators import detectors as rowwise
from sievework.operators import outliers, series
from sievework.operators.cleaning import coordinate_pair
from sievework.operators.clusters import Clustering
from sievework.operators.scores import numeric_columns
from sievework.session import kept


def all_anomalies(
    df: DataFrame,
    tie: Sequence[str],
    numeric: Sequence[str] | None = None,
    time: str | None = None,
    facility: str = "facility_id",
    keep: bool = True,
) -> DataFrame:
    """Statistical, time-series, geographic, compliance and emission checks.

    ``tie`` makes the time order unique.  Columns are found by type and by whole words of their names
    unless given: all numeric columns but ids for outliers and series, the first year or date column, the
    first latitude and longitude.

    Some dozen scans read the table, so they read a copy of it that is spread over the tasks, unless the caller says
    not to ``keep`` one.
    """
    df = kept(df) if keep else df
    columns = df.columns
    numeric = list(numeric if numeric is not None else [c for c in numeric_columns(df) if not has_token(c, "id")])
    found: list[DataFrame] = []
    if numeric:
        found.append(outliers.outlier_summary(df, outliers.outlier_tests(df, numeric), numeric))
    time = time or next((c for c in columns if has_token(c, "year", "date")), None)
    in_time = [c for c in numeric if c != time]
    if time and in_time:
        found.append(series.series_summaries(df, [time, *[t for t in tie if t != time]], in_time))
    latitude, longitude = coordinate_pair(columns)
    checks = rowwise.compliance_detectors(columns)
    if latitude and longitude:
        checks = [rowwise.impossible_locations(latitude, longitude), rowwise.coarse_locations(latitude, longitude), *checks]
        found.append(Clustering(df, latitude, longitude).summary())
    if "annual_emission_amount" in columns:
        checks.append(rowwise.zero_emissions())
        if {"reporting_year", facility}.issubset(columns):
            order = ["reporting_year", *[t for t in tie if t != "reporting_year"]]
            part = F.lit(None).cast("double")
            found.append(
                series.detector_summary(
                    series.year_spikes(df, facility, order, "annual_emission_amount"), df, "emission_spikes",
                    "emission_anomaly", "annual_emission_amount", part, "Emissions more than eleven times the year before",
                )
            )
    if checks:
        found.append(rowwise.summarise(df, checks))
    return reduce(DataFrame.unionByName, found)


def anomaly_summary(results: DataFrame) -> DataFrame:
    """One row over detector results: how many hit, totals, rate, mean severity of those above 0."""
    rows = F.count(F.lit(1))
    totals = results.agg(
        rows.alias("total_detectors"),
        F.count_if(F.col("anomaly_count") > 0).alias("detectors_with_anomalies"),
        F.floor(F.try_divide(F.sum("total_count"), rows)).alias("records_analyzed"),
        F.sum("anomaly_count").alias("anomalies_found"),
        F.coalesce(F.avg(F.when(F.col("severity_score") > 0, F.col("severity_score"))), F.lit(0.0)).alias("average_severity"),
    )
    return totals.withColumn("overall_anomaly_rate", share(F.col("anomalies_found"), F.col("records_analyzed")))


def by_type(results: DataFrame) -> DataFrame:
    return results.groupBy("anomaly_type").agg(
        F.count(F.lit(1)).alias("detectors"), F.sum("anomaly_count").alias("total_anomalies")
    )


def high_severity(results: DataFrame, above: float = 0.7) -> DataFrame:
    return results.filter(F.col("severity_score") > above)
