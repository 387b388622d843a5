"""Delimited extracts: reading, structure check, raw cleaning, sanity counts, samples."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import codes
from sievework.functions.parsing import to_date_flexible, to_identifier, to_number, to_whole, year_of
from sievework.functions.scoring import outside
from sievework.functions.text import has_token, null_tokens_removed
from sievework.sources.catalog import Source

CORRUPT_SHARE = 0.8
ORDER_COLUMNS = ("_file", "_block", "_row")
MALFORMED = "_malformed"


def csv_options(source: Source) -> dict[str, str | bool]:
    """How batch and stream read an extract alike.

    The header of every file is compared with the columns, so a file of another layout stops the read
    instead of shifting its values.
    """
    return {
        "header": True, "sep": source.delimiter, "encoding": source.encoding, "mode": "PERMISSIVE", "quote": '"', "escape": '"',
        "multiLine": source.multi_line, "enforceSchema": False, "columnNameOfCorruptRecord": MALFORMED,
    }


def header_of(spark: SparkSession, path: str, source: Source) -> list[str]:
    """Column names of the first file; reads one line."""
    return spark.read.options(**csv_options(source)).csv(path).columns


def read_delimited(
    spark: SparkSession, path: str, source: Source, header: list[str] | None = None, with_order: bool = False, with_malformed: bool = False
) -> DataFrame:
    """All-string scan of an extract; nothing is inferred, so the data is read once.

    ``with_order`` adds file, block start and a row id that grows within a block: a stable order key
    for "keep the first" without numbering rows.  ``with_malformed`` adds the text of rows that have too few or
    too many values (null for good ones).
    """
    columns = header or header_of(spark, path, source)
    schema = source.schema([*columns, MALFORMED] if with_malformed else columns)
    frame = spark.read.schema(schema).options(**csv_options(source)).csv(path)
    if with_order:
        frame = frame.select(
            *[F.col(f"`{c}`") for c in schema.names],
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
    return frame


def malformed_rows(spark: SparkSession, path: str, source: Source, header: list[str] | None = None) -> DataFrame:
    """Rows, malformed rows and rows without any value, of every file."""
    rows = read_delimited(spark, path, source, header, with_order=True, with_malformed=True)
    content = [c for c in rows.columns if c not in (*ORDER_COLUMNS, MALFORMED)]
    empty = ~reduce(or_, [F.col(f"`{c}`").isNotNull() for c in content])
    return rows.groupBy(F.col("_file").alias("file_path")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count(MALFORMED).alias("malformed_count"), F.count_if(empty).alias("empty_count")
    )


def structure_issues(spark: SparkSession, columns: list[str], source: Source) -> DataFrame:
    """Missing required columns (ERROR), missing expected and extra columns (WARNING), one per row."""
    present = set(columns)
    rows = [("missing_required", "ERROR", c) for c in source.required if c not in present]
    rows += [("missing_expected", "WARNING", c) for c in source.columns if c not in present]
    rows += [("extra_column", "WARNING", c) for c in columns if c not in source.columns]
    return spark.createDataFrame(rows, "issue string, level string, column_name string")


def clean_raw(df: DataFrame, source: Source) -> DataFrame:
    """Drop rows without any value, trim, remove null tokens, type numbers and dates.

    A row counts as empty before its tokens are removed, as when read from the file.
    """
    content = [c for c in df.columns if c not in (*ORDER_COLUMNS, MALFORMED)]
    kept = df.filter(reduce(or_, [F.col(f"`{c}`").isNotNull() for c in content]))
    typed = {c: _typed(F.col(f"`{c}`"), c, source) for c in content}
    return kept.select(*[typed[c].alias(c) if c in typed else F.col(c) for c in df.columns])


def _typed(value: Column, name: str, source: Source) -> Column:
    kind = source.types.get(name)
    if kind == "identifier":
        return to_identifier(value)
    if kind == "integer":
        return to_whole(value)
    if kind == "numeric":
        return to_number(value)
    if name in source.dates:
        return to_date_flexible(value)
    return null_tokens_removed(value)


def sanity_counts(df: DataFrame, source: Source, last_year: int) -> DataFrame:
    """Warnings of one extract in a single pass: coordinates, region, state, years, corrupt rows.

    A row is corrupt when at least 80 % of its columns are null.
    """
    present = set(df.columns)
    checks: dict[str, Column] = {}
    for name in source.coordinates:
        if name in present:
            bounds = codes.LATITUDE_RANGE if has_token(name, "lat", "latitude") else codes.LONGITUDE_RANGE
            checks[f"coordinates_{name}"] = outside(to_number(F.col(name)), bounds)
    if "epa_region_range" in source.rules and "FAC_EPA_REGION" in present:
        checks["epa_region"] = outside(to_number(F.col("FAC_EPA_REGION")), codes.REGION_RANGE)
    if "state_codes" in source.rules and "FAC_STATE" in present:
        checks["state_code"] = (F.col("FAC_STATE") != "") & ~F.col("FAC_STATE").isin(*codes.STATE_CODES)
    if "year_from" in source.rules:
        for name in ("REPORTING_YEAR", "YEARQTR"):
            if name in present:
                year = to_number(F.substring(F.col(name).cast("string"), 1, 4)) if name == "YEARQTR" else year_of(name)
                checks[f"year_{name}"] = outside(year, (source.rules["year_from"], last_year))
    content = [c for c in df.columns if c not in (*ORDER_COLUMNS, MALFORMED)]
    nulls = reduce(add, [F.col(f"`{c}`").isNull().cast("int") for c in content])
    checks["corrupt_rows"] = nulls >= CORRUPT_SHARE * len(content)
    counted = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in checks.items()])
    pairs = [F.struct(F.lit(n).alias("check_name"), F.col(n).alias("warning_count")) for n in checks]
    return counted.select("total", F.inline(F.array(*pairs))).select(
        "check_name", "warning_count", F.col("total").alias("total_count")
    )


def write_sample(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """First ``rows`` rows as CSV; the limit is the purpose of this sink."""
    df.limit(rows).write.mode("overwrite").option("header", True).csv(path)
