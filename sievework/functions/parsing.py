"""Numbers, dates and digits out of raw text. Bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.text import trimmed

# Date layouts tried in this order, each with the shape of the texts it can fit.
DATE_LAYOUTS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"), ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"), ("MMddyyyy", r"^\d{8}$"),
)
# Layouts tried last, for texts that carry a time or a month name.
LOOSE_LAYOUTS = (
    "yyyy-M-d H:m[:s]", "yyyy-M-d'T'H:m[:s][XXX]", "M/d/yyyy H:m[:s]", "MMM d, yyyy", "MMMM d, yyyy",
    "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy",
)
LOOSE_SHAPE = "[:A-Za-z]"
# Days that a count of nanoseconds can hold, for callers that need such dates.
EARLIEST, LATEST = "1677-09-22", "2262-04-11"

# Shape of a date text, by its first characters.
DATE_SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}", "YYYY-MM-DD"),
    (r"^\d{2}/\d{2}/\d{4}", "MM/DD/YYYY"),
    (r"^\d{2}-\d{2}-\d{4}", "MM-DD-YYYY"),
    (r"^\d{4}/\d{2}/\d{2}", "YYYY/MM/DD"),
)


def to_number(column: Column) -> Column:
    """Double, or null. ``12D`` and ``12F`` are text here although a Java parser would take them."""
    text = trimmed(column.cast("string"))
    return F.when(~text.rlike("[0-9.][dDfF]$"), text.try_cast("double"))


def number_in(schema: T.StructType | None, name: str) -> Column:
    """Number in a column of a known schema: numeric columns as they are, others parsed as text."""
    if schema is not None and isinstance(schema[name].dataType, T.NumericType):
        return F.col(name).cast("double")
    return to_number(F.col(name))


def date_in(schema: T.StructType | None, name: str) -> Column:
    """Date in a column of a known schema; dates and timestamps are not parsed."""
    if schema is not None and isinstance(schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("date")
    return to_date_flexible(F.col(name))


def to_whole(column: Column) -> Column:
    """Long, or null; ``"5.0"`` is 5 and a fraction is cut."""
    return to_number(column).try_cast("bigint")


def to_identifier(column: Column) -> Column:
    """Numeric id as decimal(20,0), so that 12-digit ids keep their digits."""
    return trimmed(column.cast("string")).try_cast("decimal(38,6)").try_cast("decimal(20,0)")


def to_date_flexible(column: Column, within: tuple[str, str] | None = None) -> Column:
    """Date from any of the known layouts; the first layout that fits wins.

    A layout only sees texts of its shape: a parser that fails costs far more than a pattern.
    Columns that are dates or timestamps already pass through their ISO text.  Dates outside ``within``,
    if given, count as unreadable.
    """
    text = trimmed(column.cast("string"))
    iso = text.rlike(DATE_LAYOUTS[0][1])
    tries = [F.when(F.typeof(column).startswith("timestamp"), F.substring(text, 1, 10).try_cast("date")), F.when(iso, text.try_cast("date"))]
    tries += [F.when(text.rlike(shape), F.try_to_date(text, layout)) for layout, shape in DATE_LAYOUTS[1:]]
    loose = F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)).cast("date") for layout in LOOSE_LAYOUTS])
    parsed = F.coalesce(*tries, F.when(text.rlike(LOOSE_SHAPE), loose))
    return F.when(parsed.between(*[F.lit(d).cast("date") for d in within]), parsed) if within else parsed


def date_shape(column: Column) -> Column:
    text = trimmed(column.cast("string"))
    chain = F.when(text.isNull(), None)
    for pattern, label in DATE_SHAPES:
        chain = chain.when(text.rlike(pattern), label)
    return chain.otherwise("OTHER")


def year_of(column_name: str, schema: T.StructType | None = None) -> Column:
    """Year in a ``*year*`` column; ``yearqtr`` carries it in the first four characters."""
    if column_name.replace("_", "") == "yearqtr":
        return to_number(F.substring(F.col(column_name).cast("string"), 1, 4))
    return number_in(schema, column_name)


def decimal_places(column: Column, is_text: bool = False) -> Column:
    """Digits after the point; a whole number has one (``34.0``).

    Pass the raw text when there is one.  A double is widened through its shortest decimal text, so
    34.0522 keeps four digits; exponents never appear.
    """
    if is_text:
        text = trimmed(column)
        digits = F.when(F.instr(text, ".") > 0, F.length(F.substring_index(text, ".", -1))).otherwise(0)
    else:
        text = column.try_cast("decimal(38,20)").cast("string")
        digits = F.length(F.rtrim(F.substring_index(text, ".", -1), F.lit("0")))
    return F.greatest(digits, F.lit(1))


def yes_no(column: Column) -> Column:
    """``Y``/``y`` is true; everything else, missing included, is false."""
    return F.coalesce(F.upper(column.cast("string")) == "Y", F.lit(False))


def number_text(column: Column) -> Column:
    """Whole doubles without ``.0`` or exponent, for keys that arrive as numbers."""
    return column.try_cast("decimal(38,0)").cast("string")
