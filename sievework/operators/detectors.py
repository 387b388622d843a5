"""Anomaly detectors that are row predicates: positions, compliance and emission rules.

All predicates of a table are counted in one scan.  A summary row says how many rows are anomalous,
their share of all rows, and a severity between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import codes
from sievework.functions.parsing import decimal_places, to_number
from sievework.functions.scoring import flag, outside, share

MAX_DECIMALS = 8
MIN_DECIMALS = 3
PENALTY_ABOVE = 1_000_000.0
ZERO_UP_TO = 0.001
MANY_ZEROS = 0.5

SUMMARY_COLUMNS = (
    "detector_name", "anomaly_type", "column_name", "anomaly_count", "total_count", "anomaly_rate",
    "severity_score", "description",
)


@dataclass(frozen=True)
class Detector:
    """``base`` are the rows looked at; severity is the anomalous share of them times ``scale``.

    With ``gate`` nothing is reported unless the share exceeds it.
    """

    name: str
    kind: str
    condition: Column
    base: Column
    column: str | None = None
    description: str = ""
    scale: float = 1.0
    gate: float = 0.0


def summarise(df: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    measures = [F.count(F.lit(1)).alias("total_count")]
    for i, d in enumerate(detectors):
        measures += [F.count_if(flag(d.condition) & flag(d.base)).alias(f"n{i}"), F.count_if(d.base).alias(f"b{i}")]
    counted = df.agg(*measures)
    cells = []
    for i, d in enumerate(detectors):
        part = F.coalesce(F.try_divide(F.col(f"n{i}"), F.col(f"b{i}")), F.lit(0.0))
        shown = part > d.gate if d.gate else F.lit(True)
        cells.append(
            F.struct(
                F.lit(d.name).alias("detector_name"),
                F.lit(d.kind).alias("anomaly_type"),
                F.lit(d.column).cast("string").alias("column_name"),
                F.when(shown, F.col(f"n{i}")).otherwise(F.lit(0)).alias("anomaly_count"),
                F.when(shown, F.least(part * d.scale, F.lit(1.0))).otherwise(0.0).alias("severity_score"),
                F.lit(d.description).alias("description"),
            )
        )
    return with_rate(counted.select("total_count", F.inline(F.array(*cells))))


def with_rate(summary: DataFrame) -> DataFrame:
    return summary.withColumn("anomaly_rate", share(F.col("anomaly_count"), F.col("total_count"))).select(*SUMMARY_COLUMNS)


def flagged_rows(df: DataFrame, detectors: Sequence[Detector], ids: Sequence[str]) -> DataFrame:
    """(detector_name, ids) of every anomalous row. Gates are decided by a one-row subquery."""
    marks = []
    for d in detectors:
        hit = flag(d.condition) & flag(d.base)
        if d.gate:
            part = df.agg(F.try_divide(F.count_if(hit), F.count_if(d.base)) > d.gate).scalar()
            hit = hit & flag(part)
        marks.append(F.when(hit, F.lit(d.name)))
    return df.select(F.explode(F.array_compact(F.array(*marks))).alias("detector_name"), *ids)


def impossible_locations(latitude: str, longitude: str) -> Detector:
    """Null island, out of range, equal and near the origin, or more than eight decimals."""
    lat, lon = F.col(latitude).cast("double"), F.col(longitude).cast("double")
    tests = outside(lat, codes.LATITUDE_RANGE) | outside(lon, codes.LONGITUDE_RANGE)
    # (0, 0) is also a pair of equal values near the origin, so it fails with or without null_island.
    tests |= (lat == lon) & (F.abs(lat) < 1)
    tests |= (decimal_places(F.col(latitude)) > MAX_DECIMALS) | (decimal_places(F.col(longitude)) > MAX_DECIMALS)
    return Detector(
        "impossible_locations", "geographic_impossible", tests, lat.isNotNull() & lon.isNotNull(),
        description="Points outside the globe or at a placeholder position",
    )


def coarse_locations(latitude: str, longitude: str) -> Detector:
    """Coordinates with fewer than three decimals, zero excepted."""
    lat, lon = F.col(latitude).cast("double"), F.col(longitude).cast("double")
    coarse = ((decimal_places(F.col(latitude)) < MIN_DECIMALS) & (lat != 0)) | ((decimal_places(F.col(longitude)) < MIN_DECIMALS) & (lon != 0))
    return Detector(
        "coordinate_precision", "precision_anomaly", coarse, lat.isNotNull() & lon.isNotNull(),
        description="Points given with too few decimals", scale=2.0,
    )


def _count(name: str) -> Column:
    return F.coalesce(to_number(F.col(name)), F.lit(0.0))


def violations_without_inspections(violations: str = "violation_count", inspections: str = "inspection_count") -> Detector:
    return Detector(
        "violations_without_inspections", "compliance_anomaly", (_count(violations) > 0) & (_count(inspections) == 0),
        F.lit(True), description="Violations on record, yet nobody inspected",
    )


def excessive_penalties(penalty: str = "penalty_amount") -> Detector:
    return Detector(
        "excessive_penalties", "compliance_anomaly", F.col(penalty) > PENALTY_ABOVE, F.col(penalty).isNotNull(),
        column=penalty, description="Penalties above one million dollars",
    )


def status_contradictions(status: str = "compliance_status", violations: str = "violation_count") -> Detector:
    """Good status with violations, or bad status without any."""
    word = F.upper(F.coalesce(F.col(status), F.lit("")))
    good = (_count(violations) > 0) & word.isin("COMPLIANT", "GOOD", "CLEAN")
    bad = (_count(violations) == 0) & word.isin("NON-COMPLIANT", "VIOLATION", "SNC")
    return Detector(
        "compliance_inconsistencies", "compliance_anomaly", good | bad, F.lit(True),
        description="Status and number of violations contradict each other",
    )


def zero_emissions(emission: str = "annual_emission_amount") -> Detector:
    """Zero or near-zero emissions, reported when they are more than half of all values."""
    return Detector(
        "zero_emissions", "emission_anomaly", F.col(emission) <= ZERO_UP_TO, F.col(emission).isNotNull(),
        column=emission, description="Unusually many emissions at or near zero", scale=2.0, gate=MANY_ZEROS,
    )


def compliance_detectors(columns: Sequence[str]) -> list[Detector]:
    has = set(columns).issuperset
    found = []
    if has(("inspection_count", "violation_count")):
        found.append(violations_without_inspections())
    if has(("penalty_amount",)):
        found.append(excessive_penalties())
    if has(("compliance_status", "violation_count")):
        found.append(status_contradictions())
    return found


def shared_points(df: DataFrame, latitude: str, longitude: str, more_than: int = 5) -> DataFrame:
    """Points that more than five rows share exactly; counts are combined before the shuffle."""
    return df.groupBy(latitude, longitude).agg(F.count(F.lit(1)).alias("rows_at_point")).filter(
        (F.col("rows_at_point") > more_than) & F.col(latitude).isNotNull() & F.col(longitude).isNotNull()
    )
