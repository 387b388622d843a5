"""Cleaning steps on snake_case frames. Each step is one projection, so a chain costs one scan."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import codes
from sievework.functions.parsing import number_in, to_date_flexible, to_identifier, to_number, to_whole, year_of
from sievework.functions.scoring import (
    compliance_score,
    flag,
    is_compliant,
    outside,
    region_from_position,
    unit_factor,
    unit_name,
)
from sievework.functions.text import (
    clean_name,
    either_spelling,
    has_token,
    null_tokens_removed,
    snake_case,
    upper_code,
)
from sievework.sources.catalog import Source

INVALID_COORDINATES = "_invalid_coordinates"
MISSING_REQUIRED = "_missing_required"
LATITUDE_TOKENS = ("lat", "latitude")
LONGITUDE_TOKENS = ("lon", "long", "longitude")


def rename_columns(df: DataFrame) -> DataFrame:
    """All column names to snake_case."""
    return df.withColumnsRenamed({c: snake_case(c) for c in df.columns if not c.startswith("_")})


def typed_columns(df: DataFrame, source: Source) -> DataFrame:
    """Declared numbers and dates are parsed, other texts trimmed and rid of null tokens."""
    types = {snake_case(c): kind for c, kind in source.types.items()}
    dates = set(source.snake(source.dates))
    parsers = {"identifier": to_identifier, "integer": to_whole, "numeric": to_number}
    changed: dict[str, Column] = {}
    for entry in df.schema.fields:
        name, value = entry.name, F.col(entry.name)
        if name in types:
            changed[name] = parsers[types[name]](value)
        elif name in dates:
            if not isinstance(entry.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                changed[name] = to_date_flexible(value)
        elif isinstance(entry.dataType, T.StringType) and not name.startswith("_"):
            changed[name] = null_tokens_removed(value)
    return df.withColumns(changed) if changed else df


def _coordinate_bounds(column: str) -> tuple[float, float] | None:
    if has_token(column, *LATITUDE_TOKENS):
        return codes.LATITUDE_RANGE
    if has_token(column, *LONGITUDE_TOKENS):
        return codes.LONGITUDE_RANGE
    return None


def clean_coordinates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null out impossible coordinates and mark the row, so that later steps see clean values."""
    bad = {c: flag(outside(number_in(df.schema, c), _coordinate_bounds(c))) for c in columns if c in df.columns and _coordinate_bounds(c)}
    changed = {c: F.when(~is_bad, number_in(df.schema, c)) for c, is_bad in bad.items()}
    changed[INVALID_COORDINATES] = reduce(or_, bad.values(), F.lit(False))
    return df.withColumns(changed)


def standard_identifiers(df: DataFrame) -> DataFrame:
    """Ids and state codes upper-cased and trimmed, registry ids numeric, regions within 1..10."""
    changed: dict[str, Column] = {}
    for name in df.columns:
        if name == "registry_id":
            changed[name] = to_identifier(F.col(name))
        elif name == "npdes_id" or has_token(name, "state"):
            changed[name] = upper_code(F.col(name).cast("string"))
        elif name == "fac_epa_region":
            region = number_in(df.schema, name)
            changed[name] = F.when(region.between(*codes.REGION_RANGE), region)
    return df.withColumns(changed) if changed else df


def clean_names(df: DataFrame) -> DataFrame:
    """Every text column with ``name`` in its name gets the standard form."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    changed = {c: clean_name(F.col(c)) for c in df.columns if c in texts and has_token(c, "name")}
    return df.withColumns(changed) if changed else df


def mark_missing(df: DataFrame, required: list[str]) -> DataFrame:
    nulls = [F.col(c).isNull() for c in required if c in df.columns]
    return df.withColumn(MISSING_REQUIRED, reduce(or_, nulls, F.lit(False)))


def default_values(df: DataFrame) -> DataFrame:
    """Active ``Y``, major ``N``; numeric counts, penalty and fine amounts 0.

    ``penalties`` is not ``penalty``: a missing total stays missing.
    """
    fills: dict = {}
    for entry in df.schema.fields:
        if entry.name == "fac_active_flag":
            fills[entry.name] = "Y"
        elif entry.name == "fac_major_flag":
            fills[entry.name] = "N"
        elif isinstance(entry.dataType, T.NumericType) and has_token(entry.name, "count", "penalty", "fine"):
            fills[entry.name] = 0
    return df.fillna(fills) if fills else df


def score_compliance(df: DataFrame) -> DataFrame:
    """``compliance_score`` and ``is_compliant`` from whichever violation counts the frame has."""
    found = {kind: either_spelling(df.columns, kind) for kind, _ in codes.VIOLATION_WEIGHTS}
    counts = {kind: number_in(df.schema, name) for kind, name in found.items() if name}
    if not counts:
        return df
    score = compliance_score(counts)
    return df.withColumns({"compliance_score": score, "is_compliant": is_compliant(score)})


def coordinate_pair(columns: list[str]) -> tuple[str | None, str | None]:
    latitude = next((c for c in columns if has_token(c, *LATITUDE_TOKENS)), None)
    longitude = next((c for c in columns if has_token(c, *LONGITUDE_TOKENS)), None)
    return latitude, longitude


def derive_region(df: DataFrame) -> DataFrame:
    latitude, longitude = coordinate_pair(df.columns)
    if not latitude or not longitude:
        return df
    region = region_from_position(number_in(df.schema, latitude), number_in(df.schema, longitude))
    return df.withColumn("derived_epa_region", region)


def standard_units(df: DataFrame) -> DataFrame:
    """Unit names, the factor to pounds, and the emission in pounds (0 when missing)."""
    if "unit_of_measure" not in df.columns:
        return df
    changed = {"unit_of_measure": unit_name(F.col("unit_of_measure"))}
    if "annual_emission" in df.columns:
        factor = unit_factor(F.col("unit_of_measure"))
        changed["emission_factor"] = factor
        changed["annual_emission_pounds"] = F.coalesce(number_in(df.schema, "annual_emission") * factor, F.lit(0.0))
    return df.withColumns(changed)


def apply_declared_ranges(df: DataFrame, source: Source, last_year: int) -> DataFrame:
    """Null out coordinates and years the source's own rules exclude."""
    changed: dict[str, Column] = {}
    if "coordinate_bounds" in source.rules:
        for name in source.snake(source.coordinates):
            if name in df.columns and _coordinate_bounds(name):
                changed[name] = F.when(~flag(outside(number_in(df.schema, name), _coordinate_bounds(name))), F.col(name))
    if "year_from" in source.rules:
        bounds = (source.rules["year_from"], last_year)
        for name in df.columns:
            if has_token(name, "year", "yearqtr"):
                changed[name] = F.when(~flag(outside(year_of(name, df.schema), bounds)), F.col(name))
    return df.withColumns(changed) if changed else df


def out_of_range(df: DataFrame, coordinates: list[str]) -> Column:
    """Region outside 1..10, impossible coordinates, or a penalty above the maximum."""
    tests = []
    if "fac_epa_region" in df.columns:
        tests.append(flag(outside(number_in(df.schema, "fac_epa_region"), codes.REGION_RANGE)))
    for name in coordinates:
        if name in df.columns and _coordinate_bounds(name):
            tests.append(flag(outside(number_in(df.schema, name), _coordinate_bounds(name))))
    for name in df.columns:
        if has_token(name, "penalty"):
            tests.append(flag(number_in(df.schema, name) > codes.MAX_PENALTY))
    return reduce(or_, tests, F.lit(False))


def row_anomaly(df: DataFrame, as_of: datetime) -> Column:
    """A position without a state, or a date in the future."""
    tests = []
    positions = [F.col(c) for c in ("fac_lat", "geocode_latitude") if c in df.columns]
    if positions and "fac_state" in df.columns:
        tests.append(F.coalesce(*positions).isNotNull() & F.col("fac_state").isNull())
    for entry in df.schema.fields:
        if has_token(entry.name, "date"):
            value = F.col(entry.name)
            if isinstance(entry.dataType, T.StringType):
                value = to_date_flexible(value)
            tests.append(flag(value > F.lit(as_of)))
    return reduce(or_, tests, F.lit(False))


def quality_flags(df: DataFrame, coordinates: list[str], as_of: datetime) -> DataFrame:
    """``data_quality_flags``, ``data_quality_score`` and ``requires_manual_review`` per row.

    The score is what is left of 1 after the deductions, times the share of filled columns.  The
    review flag in the text also covers missing fields and anomalies; the column looks at the score
    alone.
    """
    content = [c for c in df.columns if not c.startswith("_")]
    missing = F.col(MISSING_REQUIRED) if MISSING_REQUIRED in df.columns else F.lit(False)
    invalid = F.col(INVALID_COORDINATES) if INVALID_COORDINATES in df.columns else F.lit(False)
    ranged, anomaly = out_of_range(df, coordinates), row_anomaly(df, as_of)
    nulls = reduce(add, [F.col(c).isNull().cast("int") for c in content])
    marked = df.withColumns({"_range": ranged, "_anomaly": anomaly, "_filled": 1.0 - nulls / len(content)})
    parts = {"required": missing, "coordinates": invalid, "range": F.col("_range"), "anomaly": F.col("_anomaly")}
    left = reduce(lambda total, name: total - F.when(parts[name], codes.ROW_DEDUCTIONS[name]).otherwise(0.0), parts, F.lit(1.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), left * F.col("_filled")))
    marked = marked.withColumn("data_quality_score", score)
    low = F.col("data_quality_score") < codes.REVIEW_BELOW
    texts = F.concat_ws(
        "|",
        F.when(missing, "MISSING_REQUIRED"),
        F.when(F.col("_range"), "OUT_OF_RANGE"),
        F.when(invalid, "INVALID_COORDS"),
        F.when(F.col("_anomaly"), "ANOMALY"),
        F.when(missing | low | F.col("_anomaly"), "MANUAL_REVIEW"),
    )
    marked = marked.withColumns(
        {"data_quality_flags": F.when(texts == "", "CLEAN").otherwise(texts), "requires_manual_review": low}
    )
    return marked.drop("_range", "_anomaly", "_filled", MISSING_REQUIRED, INVALID_COORDINATES)


def dataset_flags(df: DataFrame, checkpoint_id: str, flags: list[str], as_of: datetime, batch_id: int | None = None) -> DataFrame:
    """Stamp every row with the outcome of a QA checkpoint."""
    stamps = {
        "qa_checkpoint_id": F.lit(checkpoint_id),
        "qa_quality_flags": F.lit(",".join(flags) or "CLEAN"),
        "qa_processed_date": F.lit(as_of),
    }
    if batch_id is not None:
        stamps["qa_batch_id"] = F.lit(batch_id).cast("bigint")
    return df.withColumns(stamps)
