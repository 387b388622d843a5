"""Rule-driven corrections: bad values get a declared default, a median or a rebuilt id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import codes
from sievework.functions.scoring import flag, outside
from sievework.operators import rules
from sievework.operators.quantiles import median

# Fixed values of the demonstration data set.
VALID_STATES = ("CA", "TX", "NY", "FL", "WA")
VALID_YEARS = (2000, 2024)
DEFAULTS = {"facility_name": "Unknown Environmental Facility", "state_code": "CA", "latitude": 34.0, "longitude": -118.0, "epa_region": 9, "ph_level": 7.0, "year": 2023}


@dataclass(frozen=True)
class Correction:
    """Rows matching ``when`` get the new values; later corrections see earlier ones."""

    name: str
    when: Column
    values: dict[str, Column]


def bad_coordinates() -> Column:
    return flag(outside(F.col("latitude"), codes.LATITUDE_RANGE)) | flag(outside(F.col("longitude"), codes.LONGITUDE_RANGE))


def unknown(column: str, allowed: Sequence) -> Column:
    """Not in the list; a missing value is not in it either."""
    return ~flag(F.col(column).isin(*allowed))


def issues() -> dict[str, Column]:
    """The eleven checks of the demonstration."""
    return {
        "invalid_registry_ids": F.col("registry_id") == "INVALID_ID",
        "missing_facility_names": F.col("facility_name") == "",
        "invalid_state_codes": unknown("state_code", VALID_STATES),
        "invalid_coordinates": bad_coordinates(),
        "invalid_epa_regions": unknown("epa_region", tuple(range(1, 11))),
        "zero_emissions": F.col("annual_emission_amount") <= 0,
        "invalid_ph_levels": outside(F.col("ph_level"), codes.PH_RANGE),
        "invalid_years": outside(F.col("measurement_year"), VALID_YEARS),
        "missing_npdes_ids": F.col("npdes_id") == "",
        "invalid_compliance": F.col("compliance_violations") < 0,
        "violations_no_inspections": (F.col("compliance_violations") > 0) & (F.col("inspection_count") == 0),
    }


def analyse(df: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    return rules.breakdown(df, checks or issues())


def short_issues() -> dict[str, Column]:
    """The six checks of the short demonstration."""
    return {
        "missing_names": F.col("facility_name") == "",
        "invalid_states": unknown("state_code", VALID_STATES),
        "invalid_coords": bad_coordinates(),
        "zero_emissions": F.col("emission_amount") == 0,
        "invalid_ph": outside(F.col("ph_level"), codes.PH_RANGE),
        "invalid_dates": F.col("inspection_date").cast("string").isin("2030-01-01", "1900-01-01"),
    }


def standard_corrections(df: DataFrame, number: Column) -> list[Correction]:
    """The eleven corrections; ``number`` is a stable row number for rebuilt ids.

    The median of the positive emissions is looked up first (one small collect).
    """
    emission = F.col("annual_emission_amount")
    typical = median(df, F.when(emission > 0, emission))
    checks = issues()
    digits = number.cast("string")
    return [
        Correction("registry_ids", checks["invalid_registry_ids"], {"registry_id": F.concat(F.lit("11"), F.lpad(digits, 10, "0"))}),
        Correction("facility_names", checks["missing_facility_names"], {"facility_name": F.lit(DEFAULTS["facility_name"])}),
        Correction("state_codes", checks["invalid_state_codes"], {"state_code": F.lit(DEFAULTS["state_code"])}),
        Correction("coordinates", checks["invalid_coordinates"], {"latitude": F.lit(DEFAULTS["latitude"]), "longitude": F.lit(DEFAULTS["longitude"])}),
        Correction("epa_regions", checks["invalid_epa_regions"], {"epa_region": F.lit(DEFAULTS["epa_region"])}),
        Correction("emissions", checks["zero_emissions"], {"annual_emission_amount": F.lit(typical)}),
        Correction("ph_levels", checks["invalid_ph_levels"], {"ph_level": F.lit(DEFAULTS["ph_level"])}),
        Correction("years", checks["invalid_years"], {"measurement_year": F.lit(DEFAULTS["year"])}),
        Correction("npdes_ids", checks["missing_npdes_ids"], {"npdes_id": F.concat(F.lit("XX"), F.lpad(digits, 7, "0"))}),
        Correction("compliance", checks["invalid_compliance"], {"compliance_violations": F.lit(0)}),
        Correction("business_rules", checks["violations_no_inspections"], {"inspection_count": F.lit(1)}),
    ]


def short_corrections(df: DataFrame) -> list[Correction]:
    """The corrections of the short demonstration."""
    emission = F.col("emission_amount")
    typical = median(df, F.when(emission > 0, emission))
    latitude, longitude = F.col("latitude"), F.col("longitude")
    return [
        Correction("names", F.col("facility_name") == "", {"facility_name": F.lit("Unknown Facility")}),
        Correction("states", F.col("state_code").isin("INVALID", "XX", "", "ZZ", "QQ"), {"state_code": F.lit("CA")}),
        Correction("latitudes", outside(latitude, codes.LATITUDE_RANGE), {"latitude": F.lit(34.0)}),
        Correction("longitudes", outside(longitude, codes.LONGITUDE_RANGE), {"longitude": F.lit(-118.0)}),
        Correction("emissions", emission == 0, {"emission_amount": F.lit(typical)}),
        Correction("ph_levels", outside(F.col("ph_level"), codes.PH_RANGE), {"ph_level": F.lit(7.0)}),
        Correction("dates", F.col("inspection_date").cast("string").isin("2030-01-01", "1900-01-01"), {"inspection_date": F.lit("2023-01-01")}),
    ]


def apply(df: DataFrame, corrections: Sequence[Correction]) -> DataFrame:
    """Corrected rows; types stay as they were."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in corrections:
        hit = flag(c.when)
        df = df.withColumns({n: F.when(hit, v.cast(kinds[n])).otherwise(F.col(n)) for n, v in c.values.items()})
    return df


def counts(df: DataFrame, corrections: Sequence[Correction]) -> DataFrame:
    """(correction, corrected) per correction, counted in one scan on what each of them sees."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    marked = df
    for i, c in enumerate(corrections):
        marked = marked.withColumn(f"_hit{i}", flag(c.when))
        marked = marked.withColumns({n: F.when(F.col(f"_hit{i}"), v.cast(kinds[n])).otherwise(F.col(n)) for n, v in c.values.items()})
    counted = marked.agg(*[F.count_if(f"_hit{i}").alias(f"n{i}") for i in range(len(corrections))])
    cells = F.array(*[F.struct(F.lit(c.name).alias("correction"), F.col(f"n{i}").alias("corrected")) for i, c in enumerate(corrections)])
    return counted.select(F.inline(cells))
