"""Declared sources and core tables: columns, types, rules, keys and mappings."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sievework.functions import codes
from sievework.functions.text import snake_case


@dataclass(frozen=True)
class Source:
    """One delimited extract. Column names are those of the file header."""

    name: str
    title: str
    staging_table: str
    columns: tuple[str, ...]
    required: tuple[str, ...]
    types: dict[str, str] = field(default_factory=dict)
    dates: tuple[str, ...] = ()
    coordinates: tuple[str, ...] = ()
    rules: dict[str, Any] = field(default_factory=dict)
    encoding: str = "UTF-8"
    delimiter: str = ","
    row_key: tuple[str, ...] = ()  # what one row is about; empty: found by name
    multi_line: bool = False  # quoted values hold line ends; a file is then one scan task

    @property
    def numeric(self) -> tuple[str, ...]:
        return tuple(c for c, kind in self.types.items() if kind in ("numeric", "integer"))

    def snake(self, columns: tuple[str, ...]) -> list[str]:
        return [snake_case(c) for c in columns]

    def schema(self, header: list[str] | None = None) -> T.StructType:
        """All-string schema: values are typed later by casts that give null instead of failing."""
        return T.StructType([T.StructField(c, T.StringType()) for c in header or self.columns])


_POSITION = {"lat": codes.LATITUDE_RANGE, "lon": codes.LONGITUDE_RANGE}

# The five extracts, their columns and their declared rules.
SOURCES: dict[str, Source] = {
    source.name: source
    for source in (
        Source(
            name="echo_facilities",
            title="ECHO_EXPORTER",
            staging_table="echo_facilities",
            columns=(
                "REGISTRY_ID", "FAC_NAME", "FAC_STREET", "FAC_CITY", "FAC_STATE", "FAC_ZIP", "FAC_COUNTY",
                "FAC_FIPS_CODE", "FAC_EPA_REGION", "FAC_LAT", "FAC_LONG", "FAC_ACTIVE_FLAG",
                "FAC_MAJOR_FLAG", "NPDES_FLAG", "AIR_FLAG", "RCRA_FLAG", "TRI_FLAG", "GHG_FLAG",
                "FAC_INSPECTION_COUNT", "FAC_COMPLIANCE_STATUS",
            ),
            required=("REGISTRY_ID", "FAC_NAME", "FAC_STATE", "FAC_EPA_REGION"),
            types={
                "REGISTRY_ID": "identifier", "FAC_FIPS_CODE": "numeric", "FAC_EPA_REGION": "numeric",
                "FAC_LAT": "numeric", "FAC_LONG": "numeric", "FAC_PERCENT_MINORITY": "numeric",
                "FAC_POP_DEN": "numeric", "FAC_INSPECTION_COUNT": "integer",
                "FAC_TOTAL_PENALTIES": "numeric", "FAC_PENALTY_COUNT": "integer",
            },
            dates=(
                "FAC_DATE_LAST_INSPECTION", "FAC_DATE_LAST_FORMAL_ACTION", "FAC_DATE_LAST_PENALTY",
                "CAA_DATE_LAST_FORMAL_ACTION", "CWA_DATE_LAST_FORMAL_ACTION",
                "RCRA_DATE_LAST_FORMAL_ACTION",
            ),
            coordinates=("FAC_LAT", "FAC_LONG"),
            rules={
                "coordinate_bounds": _POSITION,
                "epa_region_range": codes.REGION_RANGE,
                "state_codes": codes.STATE_CODES,
                "boolean_flags": ("Y", "N", ""),
                "max_penalty_amount": codes.MAX_PENALTY,
            },
        ),
        Source(
            name="icis_facilities",
            title="ICIS_FACILITIES",
            staging_table="icis_facilities",
            columns=(
                "ICIS_FACILITY_INTEREST_ID", "NPDES_ID", "FACILITY_UIN", "FACILITY_TYPE_CODE",
                "FACILITY_NAME", "LOCATION_ADDRESS", "CITY", "COUNTY_CODE", "STATE_CODE", "ZIP",
                "GEOCODE_LATITUDE", "GEOCODE_LONGITUDE", "IMPAIRED_WATERS",
            ),
            required=("NPDES_ID", "FACILITY_NAME", "STATE_CODE"),
            types={
                "ICIS_FACILITY_INTEREST_ID": "integer", "FACILITY_UIN": "numeric",
                "GEOCODE_LATITUDE": "numeric", "GEOCODE_LONGITUDE": "numeric",
            },
            coordinates=("GEOCODE_LATITUDE", "GEOCODE_LONGITUDE"),
            rules={
                "coordinate_bounds": _POSITION,
                "npdes_id_pattern": codes.NPDES_ID_PATTERN,
                "state_codes": codes.STATE_CODES,
            },
        ),
        Source(
            name="icis_permits",
            title="ICIS_PERMITS",
            staging_table="icis_permits",
            columns=(
                "ACTIVITY_ID", "EXTERNAL_PERMIT_NMBR", "VERSION_NMBR", "FACILITY_TYPE_INDICATOR",
                "PERMIT_TYPE_CODE", "MAJOR_MINOR_STATUS_FLAG", "PERMIT_STATUS_CODE",
                "TOTAL_DESIGN_FLOW_NMBR", "ACTUAL_AVERAGE_FLOW_NMBR", "STATE_WATER_BODY", "PERMIT_NAME",
                "AGENCY_TYPE_CODE", "ORIGINAL_ISSUE_DATE", "ISSUE_DATE", "EFFECTIVE_DATE",
                "EXPIRATION_DATE", "RETIREMENT_DATE", "TERMINATION_DATE",
            ),
            required=("EXTERNAL_PERMIT_NMBR", "PERMIT_TYPE_CODE", "PERMIT_STATUS_CODE"),
            types={
                "ACTIVITY_ID": "integer", "VERSION_NMBR": "integer", "TOTAL_DESIGN_FLOW_NMBR": "numeric",
                "ACTUAL_AVERAGE_FLOW_NMBR": "numeric",
            },
            dates=(
                "ORIGINAL_ISSUE_DATE", "ISSUE_DATE", "EFFECTIVE_DATE", "EXPIRATION_DATE",
                "RETIREMENT_DATE", "TERMINATION_DATE",
            ),
            rules={
                "permit_status_codes": codes.PERMIT_STATUS_CODES,
                "major_minor_flags": codes.MAJOR_MINOR_FLAGS,
                "flow_range": codes.FLOW_RANGE,
                "date_order": ("effective_date", "expiration_date"),
            },
        ),
        Source(
            name="npdes_measurements",
            title="NPDES_QNCR_HISTORY",
            staging_table="npdes_measurements",
            columns=(
                "NPDES_ID", "YEARQTR", "HLRNC", "NUME90Q", "NUMCVDT", "NUMSVCD", "NUMPSCH", "NUMD8090Q",
            ),
            required=("NPDES_ID", "YEARQTR"),
            types={
                "NUME90Q": "integer", "NUMCVDT": "integer", "NUMSVCD": "integer", "NUMPSCH": "integer",
                "NUMD8090Q": "integer",
            },
            rules={
                "yearqtr_pattern": codes.YEARQTR_PATTERN,
                "year_from": codes.FIRST_YEAR,
                "quarter_range": (1, 4),
                "violation_counts": codes.VIOLATION_COUNT_RANGE,
                "hlrnc_codes": codes.HLRNC_CODES,
            },
        ),
        Source(
            name="air_emissions",
            title="POLL_RPT_COMBINED_EMISSIONS",
            staging_table="air_emissions",
            columns=(
                "REPORTING_YEAR", "REGISTRY_ID", "PGM_SYS_ACRNM", "PGM_SYS_ID", "POLLUTANT_NAME",
                "ANNUAL_EMISSION", "UNIT_OF_MEASURE", "NEI_TYPE", "NEI_HAP_VOC_FLAG",
            ),
            row_key=("REGISTRY_ID", "REPORTING_YEAR", "POLLUTANT_NAME", "PGM_SYS_ACRNM", "PGM_SYS_ID"),
            required=("REPORTING_YEAR", "REGISTRY_ID", "POLLUTANT_NAME", "ANNUAL_EMISSION"),
            types={"REPORTING_YEAR": "integer", "REGISTRY_ID": "identifier", "ANNUAL_EMISSION": "numeric"},
            rules={
                "year_from": codes.FIRST_EMISSION_YEAR,
                "emission_range": codes.EMISSION_RANGE,
                "unit_measures": codes.UNIT_NAMES,
                "program_systems": codes.PROGRAM_SYSTEMS,
                "hap_voc_flags": codes.HAP_VOC_FLAGS,
            },
        ),
    )
}

# Not one of the five extracts: rows of facility, programme and period, as a user may derive or receive them.
COMPLIANCE_HISTORY = Source(
    name="compliance_history",
    title="COMPLIANCE_HISTORY",
    staging_table="compliance_history",
    columns=(
        "REGISTRY_ID", "PROGRAM_TYPE", "COMPLIANCE_YEAR", "COMPLIANCE_QUARTER", "INSPECTION_COUNT", "LAST_INSPECTION_DATE",
        "INFORMAL_ACTION_COUNT", "FORMAL_ACTION_COUNT", "LAST_FORMAL_ACTION_DATE", "TOTAL_PENALTIES", "PENALTY_COUNT", "LAST_PENALTY_DATE",
        "LAST_PENALTY_AMOUNT", "QUARTERS_WITH_NONCOMPLIANCE", "HAS_SIGNIFICANT_NONCOMPLIANCE", "OVERALL_COMPLIANCE_STATUS",
    ),
    row_key=("REGISTRY_ID", "PROGRAM_TYPE", "COMPLIANCE_YEAR", "COMPLIANCE_QUARTER"),
    required=("REGISTRY_ID", "PROGRAM_TYPE", "COMPLIANCE_YEAR"),
    types={
        "REGISTRY_ID": "identifier", "COMPLIANCE_YEAR": "integer", "COMPLIANCE_QUARTER": "integer", "INSPECTION_COUNT": "integer",
        "INFORMAL_ACTION_COUNT": "integer", "FORMAL_ACTION_COUNT": "integer", "TOTAL_PENALTIES": "numeric", "PENALTY_COUNT": "integer",
        "LAST_PENALTY_AMOUNT": "numeric", "QUARTERS_WITH_NONCOMPLIANCE": "integer",
    },
    dates=("LAST_INSPECTION_DATE", "LAST_FORMAL_ACTION_DATE", "LAST_PENALTY_DATE"),
)

LOAD_ORDER = ("icis_facilities", "npdes_measurements", "icis_permits", "air_emissions", "echo_facilities")


def source(name: str) -> Source:
    if name == COMPLIANCE_HISTORY.name:
        return COMPLIANCE_HISTORY
    try:
        return SOURCES[name]
    except KeyError:
        raise ValueError(f"Unknown source: {name}") from None


@dataclass(frozen=True)
class CoreTable:
    """Target table: where its columns come from and which keys it has.

    ``unique`` is the key an upsert matches on.  ``yearqtr`` maps to two columns.  A table with ``open_key``
    columns takes rows that leave these null (a whole year without quarter), once per key, and refuses rows that
    leave other parts of the key null.
    """

    name: str
    staging_table: str
    primary_key: str
    unique: tuple[str, ...]
    required: tuple[str, ...]
    mapping: dict[str, str | tuple[str, str]]
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)  # column -> (table, lookup key)
    partition_by: tuple[str, ...] = ()
    open_key: tuple[str, ...] = ()


# Staging column -> core column.
CORE_TABLES: dict[str, CoreTable] = {
    table.name: table
    for table in (
        CoreTable(
            name="facilities",
            staging_table="echo_facilities",
            primary_key="facility_id",
            unique=("registry_id",),
            required=("facility_name", "state_code"),
            mapping={
                "registry_id": "registry_id", "fac_name": "facility_name", "fac_street": "street_address",
                "fac_city": "city", "fac_state": "state_code", "fac_zip": "zip_code",
                "fac_county": "county", "fac_epa_region": "epa_region", "fac_lat": "latitude",
                "fac_long": "longitude", "fac_active_flag": "is_active",
                "fac_major_flag": "is_major_facility", "npdes_flag": "has_water_permits",
                "air_flag": "has_air_permits", "rcra_flag": "has_waste_permits",
                "tri_flag": "has_tri_reporting",
            },
        ),
        CoreTable(
            name="permits",
            staging_table="icis_permits",
            primary_key="permit_id",
            unique=("npdes_id",),
            required=("external_permit_number", "permit_type_code"),
            # The permit number is the NPDES id; without that line the table has no key to match on.
            mapping={
                "external_permit_nmbr": "external_permit_number", "permit_type_code": "permit_type_code",
                "permit_status_code": "permit_status_code", "major_minor_status_flag": "major_minor_status",
                "total_design_flow_nmbr": "total_design_flow_mgd",
                "actual_average_flow_nmbr": "actual_average_flow_mgd", "effective_date": "effective_date",
                "expiration_date": "expiration_date", "npdes_id": "npdes_id", "registry_id": "registry_id",
            },
            foreign={"facility_id": ("facilities", "registry_id")},
        ),
        CoreTable(
            name="water_measurements",
            staging_table="npdes_measurements",
            primary_key="measurement_id",
            unique=("npdes_id", "measurement_year", "measurement_quarter"),
            required=("npdes_id", "measurement_year"),
            mapping={
                "npdes_id": "npdes_id", "yearqtr": ("measurement_year", "measurement_quarter"),
                "nume90_q": "effluent_violations_90day", "numcvdt": "compliance_violations",
                "numsvcd": "single_event_violations", "numpsch": "schedule_violations",
                "hlrnc": "hlrnc_status",
            },
            foreign={"permit_id": ("permits", "npdes_id")},
            partition_by=("measurement_year",),
        ),
        CoreTable(
            name="air_emissions",
            staging_table="air_emissions",
            primary_key="emission_id",
            # Program system belongs to the declared key; leaving it out would merge programs.
            unique=(
                "registry_id", "reporting_year", "pollutant_name", "program_system_acronym",
                "program_system_id",
            ),
            required=("registry_id", "reporting_year", "pollutant_name"),
            mapping={
                "registry_id": "registry_id", "reporting_year": "reporting_year",
                "pollutant_name": "pollutant_name", "annual_emission": "annual_emission_amount",
                "unit_of_measure": "emission_unit_of_measure", "pgm_sys_acrnm": "program_system_acronym",
                "pgm_sys_id": "program_system_id",
            },
            foreign={"facility_id": ("facilities", "registry_id")},
            partition_by=("reporting_year",),
        ),
        CoreTable(
            name="compliance_history",
            staging_table="compliance_history",
            primary_key="compliance_id",
            unique=("facility_id", "program_type", "compliance_year", "compliance_quarter"),
            required=("facility_id", "program_type"),
            mapping={
                c: c
                for c in (
                    "registry_id", "program_type", "compliance_year", "compliance_quarter",
                    "inspection_count", "last_inspection_date", "informal_action_count",
                    "formal_action_count", "last_formal_action_date", "total_penalties", "penalty_count",
                    "last_penalty_date", "last_penalty_amount", "quarters_with_noncompliance",
                    "has_significant_noncompliance", "overall_compliance_status",
                )
            },
            foreign={"facility_id": ("facilities", "registry_id")},
            partition_by=("compliance_year",),
            open_key=("compliance_quarter",),
        ),
    )
}

# Columns of the ICIS facilities in terms of the facility master.
ICIS_TO_FACILITIES = {
    "facility_name": "facility_name", "location_address": "street_address", "city": "city", "county_code": "county",
    "state_code": "state_code", "zip": "zip_code", "geocode_latitude": "latitude", "geocode_longitude": "longitude",
}

CORE_LOAD_ORDER = ("facilities", "permits", "air_emissions", "water_measurements", "compliance_history")


def core_table(name: str) -> CoreTable:
    try:
        return CORE_TABLES[name]
    except KeyError:
        raise ValueError(f"Unknown target table: {name}") from None


def readiness(spark: SparkSession, configs: dict[str, dict[str, Any]], existing_tables: list[str]) -> DataFrame:
    """One row per source configuration: usable or not, its issues and what else to add.

    A configuration is a plain mapping, as a user would write it; the findings table has to exist too.
    """
    has_findings = "qa_findings" in existing_tables
    rows = []
    for name, config in configs.items():
        issues = [f"Missing required field: {f}" for f in ("name", "staging_table", "required_columns") if f not in config]
        valid = not issues
        advice = []
        rules = config.get("validation_rules", {})
        if not isinstance(rules, dict):
            issues.append("validation_rules should be a dictionary")
        elif "validation_rules" in config:
            absent = [r for r in ("required_fields", "data_types", "ranges") if r not in rules]
            if absent:
                advice.append("Consider adding validation rules for: " + ", ".join(absent))
        if not has_findings:
            advice.append("Findings table not found: create qa_findings")
        rows.append((name, valid, issues, advice, has_findings))
    return spark.createDataFrame(
        rows,
        "source_name string, valid boolean, issues array<string>, recommendations array<string>, "
        "findings_table_exists boolean",
    )


def as_config(entry: Source) -> dict[str, Any]:
    """A declared source in the mapping form :func:`readiness` checks."""
    return {
        "name": entry.title,
        "staging_table": entry.staging_table,
        "required_columns": list(entry.required),
        "validation_rules": dict(entry.rules),
    }
