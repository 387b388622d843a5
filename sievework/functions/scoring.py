"""Scores, grades, units and regions as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import codes


def outside(value: Column, bounds: tuple[float, float]) -> Column:
    """True when a value is present and out of bounds; null when it is missing."""
    low, high = bounds
    return (value < low) | (value > high)


def flag(condition: Column) -> Column:
    """A predicate as plain true/false: null counts as false."""
    return F.coalesce(condition, F.lit(False))


def share(part: Column, whole: Column) -> Column:
    """Percentage, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def compliance_score(violations: dict[str, Column]) -> Column:
    """100 minus the weighted violations in percent of twenty, never below 0; missing counts are 0."""
    weights = dict(codes.VIOLATION_WEIGHTS)
    weighted = [F.coalesce(c, F.lit(0.0)) * weights[kind] for kind, c in violations.items()]
    total = reduce(add, weighted, F.lit(0.0))
    return F.greatest(F.lit(0.0), 100.0 - total / codes.VIOLATIONS_FOR_ZERO_SCORE * 100.0)


def is_compliant(score: Column) -> Column:
    return score >= codes.COMPLIANT_FROM


def region_from_position(latitude: Column, longitude: Column) -> Column:
    """First of the ten boxes that holds the position, else null.

    The first box has no eastern or northern end, so boxes 2, 7, 8 and 10 can never win; the rule is
    kept as published.
    """
    chain = None
    for region, lat_from, lat_below, lon_above, lon_to in codes.REGION_BOXES:
        inside = (latitude >= lat_from) & (longitude <= lon_to)
        if lat_below is not None:
            inside &= latitude < lat_below
        if lon_above is not None:
            inside &= longitude > lon_above
        chain = F.when(inside, region) if chain is None else chain.when(inside, region)
    return chain


def _unit_lookup(unit: Column, position: int) -> Column:
    key = F.upper(F.btrim(unit))
    chain = None
    for row in codes.UNITS:
        chain = F.when(key == row[0], row[position]) if chain is None else chain.when(key == row[0], row[position])
    return chain


def unit_name(unit: Column) -> Column:
    """Display name of a unit, any case; unknown units are only upper-cased."""
    return F.coalesce(_unit_lookup(unit, 1), F.upper(unit))


def unit_factor(unit: Column) -> Column:
    """Factor to pounds, any case; 1 for unknown or missing units."""
    return F.coalesce(_unit_lookup(unit, 2), F.lit(1.0))


def graded(score: Column, steps: tuple[tuple[float, str], ...], last: str) -> Column:
    chain = None
    for low, letter in steps:
        chain = F.when(score >= low, letter) if chain is None else chain.when(score >= low, letter)
    return chain.otherwise(last)


def letter_grade(score: Column) -> Column:
    return graded(score, codes.LETTER_GRADES, "F")


def fine_grade(score: Column) -> Column:
    return graded(score, codes.FINE_GRADES, "D")


def score_band(score: Column) -> Column:
    bands = ((90.0, "excellent_90_plus"), (80.0, "good_80_89"), (70.0, "acceptable_70_79"))
    return graded(score, bands, "needs_improvement_below_70")


def percent_change(before: Column, after: Column) -> Column:
    """Gain in percent of ``before``; 0 when ``before`` is not positive."""
    return F.when(before > 0, (after - before) / before * 100.0).otherwise(0.0)


def fixed_point(value: Column, digits: int = 1) -> Column:
    """Number text with a fixed count of decimals, without grouping."""
    return F.format_string(f"%.{digits}f", value.cast("double"))
