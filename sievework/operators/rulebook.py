"""The rules: per-table field lists, ranges, patterns, cross-field logic and table constraints.

``columns`` is a list of names or, better, the schema of the frame: values of numeric and date columns are
then compared as they are, only texts are parsed.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import codes
from sievework.functions.parsing import date_in, number_in
from sievework.functions.scoring import outside
from sievework.functions.text import trimmed
from sievework.operators.rules import CRITICAL, Rule

# Which fields each kind of rule looks at.
REQUIRED_FIELDS = {
    "facilities": ("registry_id", "facility_name", "state_code"),
    "permits": ("npdes_id", "external_permit_number", "permit_type_code"),
    "water_measurements": ("npdes_id", "measurement_year"),
    "air_emissions": ("registry_id", "reporting_year", "pollutant_name"),
    "compliance_history": ("facility_id", "program_type"),
}
NUMERIC_FIELDS = (
    "registry_id", "latitude", "longitude", "epa_region", "annual_emission_amount",
    "total_design_flow_mgd", "measurement_year", "reporting_year",
)
DATE_FIELDS = ("effective_date", "expiration_date", "last_inspection_date", "created_date", "updated_date")
TEXT_FIELDS = ("facility_name", "state_code", "npdes_id", "pollutant_name")
YEAR_FIELDS = ("measurement_year", "reporting_year")
PH_FIELDS = ("ph_value", "ph_level")
FLOW_FIELDS = ("total_design_flow_mgd", "actual_average_flow_mgd")


Columns = Sequence[str] | T.StructType


def names_of(columns: Columns) -> Sequence[str]:
    return columns.names if isinstance(columns, T.StructType) else columns


def schema_of(columns: Columns) -> T.StructType | None:
    return columns if isinstance(columns, T.StructType) else None


def text(name: str) -> Column:
    return F.col(name).cast("string")


def blank(name: str) -> Column:
    return F.col(name).isNull() | (trimmed(text(name)) == "")


def required_fields(columns: Columns, table: str, fields: Sequence[str] | None = None) -> Rule:
    """Fails when any required field is null or blank; a field without a column fails every row.

    A table without declared fields has nothing to fail.
    """
    wanted = fields if fields is not None else REQUIRED_FIELDS.get(table, ())
    present = set(names_of(columns))
    tests = [blank(f) if f in present else F.lit(True) for f in wanted]
    return Rule(
        f"required_fields_{table}",
        reduce(or_, tests, F.lit(False)),
        severity=CRITICAL,
        message="Required values absent: " + ", ".join(wanted),
        finding_type="MISSING_VALUE",
        group="required",
    )


def numeric_type(field: str, schema: T.StructType | None = None) -> Rule:
    return Rule(
        f"numeric_type_{field}", F.col(field).isNotNull() & number_in(schema, field).isNull(),
        message=f"Not a number: {field}", column=field, finding_type="INVALID_FORMAT", group="type",
    )


def date_type(field: str, as_of: datetime, schema: T.StructType | None = None) -> Rule:
    """Fails when unreadable, before 1970, or more than a year ahead."""
    parsed = date_in(schema, field)
    earliest, latest = F.lit(f"{codes.FIRST_YEAR}-01-01").cast("date"), F.lit((as_of + timedelta(days=365)).date())
    bad = F.col(field).isNotNull() & (parsed.isNull() | (parsed < earliest) | (parsed > latest))
    return Rule(f"date_type_{field}", bad, message=f"Not a date: {field}", column=field, finding_type="INVALID_FORMAT", group="type")


def text_format(field: str) -> Rule:
    """Pattern for ids, code list for states, non-empty for the rest."""
    value = trimmed(text(field))
    if field == "npdes_id":
        bad = ~value.rlike(codes.NPDES_ID_PATTERN)
    elif field == "registry_id":
        bad = ~value.rlike(codes.REGISTRY_ID_PATTERN)
    elif field == "state_code":
        bad = ~F.upper(value).isin(*codes.STATE_CODES)
    else:
        bad = value == ""
    return Rule(f"string_format_{field}", bad, message=f"Not of the declared form: {field}", column=field, finding_type="INVALID_FORMAT", group="type")


def data_types(columns: Columns, as_of: datetime) -> list[Rule]:
    present, schema = set(names_of(columns)), schema_of(columns)
    rules = [numeric_type(f, schema) for f in NUMERIC_FIELDS if f in present]
    rules += [date_type(f, as_of, schema) for f in DATE_FIELDS if f in present]
    rules += [text_format(f) for f in (*TEXT_FIELDS, "registry_id") if f in present]
    return rules


def ranged(name: str, field: str, bounds: tuple[float, float], message: str, schema: T.StructType | None = None) -> Rule:
    return Rule(name, outside(number_in(schema, field), bounds), message=message, column=field)


def member(name: str, field: str, allowed: Sequence, message: str, ignore_case: bool = False) -> Rule:
    value = F.upper(trimmed(text(field))) if ignore_case else text(field)
    return Rule(name, ~value.isin(*allowed), message=message, column=field, finding_type="INVALID_FORMAT")


def matches(name: str, field: str, pattern: str, message: str) -> Rule:
    return Rule(name, ~text(field).rlike(pattern), message=message, column=field, finding_type="INVALID_FORMAT")


def business(columns: Columns, as_of: datetime) -> list[Rule]:
    present, schema, rules = set(names_of(columns)), schema_of(columns), []
    for field, bounds in (("latitude", codes.LATITUDE_RANGE), ("longitude", codes.LONGITUDE_RANGE)):
        if field in present:
            rules.append(ranged(f"coordinate_bounds_{field}", field, bounds, f"Coordinates out of bounds in {field}", schema))
    if "epa_region" in present:
        region = number_in(schema, "epa_region").try_cast("bigint")
        bad = F.col("epa_region").isNotNull() & (region.isNull() | outside(region, codes.REGION_RANGE))
        rules.append(Rule("epa_regions", bad, message="No region of that number", column="epa_region"))
    if "state_code" in present:
        rules.append(member("state_codes", "state_code", codes.STATE_CODES, "No such state code", ignore_case=True))
    for field in YEAR_FIELDS:
        if field in present:
            rules.append(ranged(f"year_range_{field}", field, (codes.FIRST_YEAR, as_of.year), f"Invalid year range in {field}", schema))
    if "annual_emission_amount" in present:
        rules.append(ranged("emission_ranges", "annual_emission_amount", codes.EMISSION_RANGE, "Emission outside the allowed range", schema))
    for field in FLOW_FIELDS:
        if field in present:
            rules.append(ranged(f"flow_ranges_{field}", field, codes.FLOW_RANGE, f"Invalid flow ranges in {field}", schema))
    return rules


def date_order(earlier: str, later: str, name: str = "permit_date_logic", schema: T.StructType | None = None) -> Rule:
    """Fails when the first date is not before the second."""
    start, end = date_in(schema, earlier), date_in(schema, later)
    return Rule(
        name, start >= end, message=f"Permit {earlier.replace('_', ' ')} >= {later.replace('_', ' ')}",
        finding_type="BUSINESS_RULE", group="cross",
    )


def both_or_none(first: str, second: str, name: str = "coordinate_consistency") -> Rule:
    return Rule(
        name, F.col(first).isNull() != F.col(second).isNull(),
        message="Only one of two coordinates is given", finding_type="BUSINESS_RULE", group="cross",
    )


def not_above(value: str, limit: str, name: str = "flow_consistency", schema: T.StructType | None = None) -> Rule:
    return Rule(
        name, number_in(schema, value) > number_in(schema, limit), message="More flow than the design allows",
        finding_type="BUSINESS_RULE", group="cross",
    )


def cross_field(columns: Columns) -> list[Rule]:
    has, schema = set(names_of(columns)).issuperset, schema_of(columns)
    rules = []
    if has(("effective_date", "expiration_date")):
        rules.append(date_order("effective_date", "expiration_date", schema=schema))
    if has(("latitude", "longitude")):
        rules.append(both_or_none("latitude", "longitude"))
    if has(("actual_average_flow_mgd", "total_design_flow_mgd")):
        rules.append(not_above("actual_average_flow_mgd", "total_design_flow_mgd", schema=schema))
    return rules


def all_rules(columns: Columns, table: str, as_of: datetime) -> list[Rule]:
    return [required_fields(columns, table), *data_types(columns, as_of), *business(columns, as_of), *cross_field(columns)]


def stage_rules(columns: Columns, table: str, stage: str, as_of: datetime) -> list[Rule]:
    """The part of the rule book an ETL stage runs; unknown stages run all of it."""
    if stage.lower() == "extract":
        return [required_fields(columns, table), *data_types(columns, as_of)]
    if stage.lower() == "transform":
        return [*business(columns, as_of), *cross_field(columns)]
    return all_rules(columns, table, as_of)


def declared_sets(columns: Columns) -> list[Rule]:
    """Code sets and ranges that sources declare: statuses, flags, pH, HLRNC, programs, units, counts."""
    has, schema = set(names_of(columns)), schema_of(columns)
    rules = []
    for field, allowed in (
        ("permit_status_code", codes.PERMIT_STATUS_CODES),
        ("major_minor_status_flag", codes.MAJOR_MINOR_FLAGS),
        ("compliance_status_code", codes.COMPLIANCE_STATUS_CODES),
        ("hlrnc", codes.HLRNC_CODES),
        ("pgm_sys_acrnm", codes.PROGRAM_SYSTEMS),
        ("nei_hap_voc_flag", codes.HAP_VOC_FLAGS),
        ("unit_of_measure", codes.UNIT_NAMES),
    ):
        if field in has:
            rules.append(member(f"code_set_{field}", field, allowed, f"Unknown code in {field}"))
    for field in PH_FIELDS:
        if field in has:
            rules.append(ranged(f"ph_range_{field}", field, codes.PH_RANGE, f"pH out of range in {field}", schema))
    for field in ("nume90q", "nume90_q", "numcvdt", "numsvcd", "numpsch", "numd8090q", "numd8090_q"):
        if field in has:
            rules.append(ranged(f"violation_count_{field}", field, codes.VIOLATION_COUNT_RANGE, f"Unlikely count in {field}", schema))
    if "yearqtr" in has:
        rules.append(matches("pattern_yearqtr", "yearqtr", codes.YEARQTR_PATTERN, "YEARQTR is not YYYYQ"))
    for field in ("fac_total_penalties", "penalty_amount", "total_penalties"):
        if field in has:
            rules.append(ranged(f"max_penalty_{field}", field, (float("-inf"), codes.MAX_PENALTY), f"Penalty too high in {field}", schema))
    return rules


def constraints(table: str, columns: Columns, as_of: datetime) -> list[Rule]:
    """NOT NULL and CHECK constraints of a core table as rules; absent columns are skipped."""
    year, present, schema = as_of.year, set(names_of(columns)), schema_of(columns)
    not_null = {
        "facilities": ("facility_name", "state_code"),
        "permits": ("facility_id", "external_permit_number", "permit_type_code", "permit_status_code"),
        "water_measurements": ("permit_id", "npdes_id", "measurement_year", "measurement_quarter"),
        "air_emissions": (
            "facility_id", "registry_id", "reporting_year", "program_system_acronym", "pollutant_name",
            "emission_unit_of_measure",
        ),
        "compliance_history": ("facility_id", "program_type", "compliance_year"),
        "etl_run_log": ("batch_id", "process_name", "status"),
    }
    ranges = {
        "facilities": {
            "epa_region": codes.REGION_RANGE, "latitude": codes.LATITUDE_RANGE, "longitude": codes.LONGITUDE_RANGE,
            "percent_minority": (0, 100), "population_density": (0, None),
        },
        "permits": {"total_design_flow_mgd": (0, None), "actual_average_flow_mgd": (0, None)},
        "water_measurements": {
            "measurement_year": (codes.FIRST_YEAR, year), "measurement_quarter": (1, 4),
            **{c: (0, None) for c in (
                "effluent_violations_90day", "compliance_violations", "single_event_violations",
                "schedule_violations", "dmr_violations_80_90day",
            )},
        },
        "air_emissions": {"reporting_year": (codes.FIRST_EMISSION_YEAR, year), "annual_emission_amount": (0, None)},
        "compliance_history": {
            "compliance_year": (codes.FIRST_YEAR, year), "compliance_quarter": (1, 4),
            **{c: (0, None) for c in (
                "inspection_count", "days_since_last_inspection", "informal_action_count",
                "formal_action_count", "total_penalties", "penalty_count", "last_penalty_amount",
                "quarters_with_noncompliance",
            )},
        },
    }
    enums = {
        "permits": {"major_minor_status": codes.CORE_MAJOR_MINOR},
        "compliance_history": {"program_type": codes.PROGRAM_TYPES},
        "etl_run_log": {"status": codes.RUN_STATUSES},
    }
    rules = [
        Rule(f"not_null_{c}", F.col(c).isNull(), severity=CRITICAL, message=f"{c} is null", column=c, finding_type="MISSING_VALUE", group="required")
        for c in not_null.get(table, ()) if c in present
    ]
    for c, (low, high) in ranges.get(table, {}).items():
        if c in present:
            value = number_in(schema, c)
            bad = value < low if high is None else outside(value, (low, high))
            rules.append(Rule(f"check_{c}", bad, message=f"{c} out of range", column=c))
    for c, allowed in enums.get(table, {}).items():
        if c in present:
            rules.append(member(f"check_{c}", c, allowed, f"{c} not allowed"))
    if table == "permits" and {"effective_date", "expiration_date"}.issubset(present):
        rules.append(date_order("effective_date", "expiration_date", "check_expiration_date", schema))
    return rules
