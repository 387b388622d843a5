"""Statistical outliers in numeric columns: z-score, IQR and modified z-score.

The statistics of all columns are gathered first (a few one-row aggregates), then every condition is
a comparison with constants: one scan counts them all, and range conditions can reach the file scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.detectors import SUMMARY_COLUMNS, with_rate
from sievework.operators.quantiles import SKETCH_ACCURACY, exact_quantiles

Z_ABOVE = 3.0
IQR_TIMES = 1.5
MODIFIED_Z_ABOVE = 3.5
MODIFIED_Z_SCALE = 0.6745
METHODS = ("z_score", "iqr", "modified_z_score")


@dataclass(frozen=True)
class Test:
    """One method on one column: the condition, its score, and the severity of the worst value."""

    method: str
    column: str
    condition: Column
    score: Column
    severity: float
    severity_needs_rows: bool
    description: str


def _finite(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float]]:
    """count, mean, population deviation, min and max per column, in one pass. Collects one row."""
    measures = {"n": F.count, "mean": F.avg, "std": F.stddev_pop, "low": F.min, "high": F.max}
    row = df.agg(*[f(_finite(c)).alias(f"{m}{i}") for i, c in enumerate(columns) for m, f in measures.items()]).first()
    return {c: {m: row[f"{m}{i}"] for m in measures} for i, c in enumerate(columns)}


def _z_scores(known: dict[str, dict[str, float]]) -> list[Test]:
    """|x - mean| / population deviation above 3; needs three values and some spread."""
    tests = []
    for name, s in known.items():
        if s["n"] < 3 or not s["std"]:
            continue
        score = F.abs((_finite(name) - s["mean"]) / s["std"])
        worst = max(s["high"] - s["mean"], s["mean"] - s["low"]) / s["std"]
        tests.append(Test("z_score", name, score > Z_ABOVE, score, min(worst / (2 * Z_ABOVE), 1.0), False, f"Z-score outliers in {name} (threshold: {Z_ABOVE})"))
    return tests


def _quartile_ranges(known: dict[str, dict[str, float]], quartiles: dict[str, list]) -> list[Test]:
    """Outside the quartiles by more than 1.5 interquartile ranges; needs four values."""
    tests = []
    for name, s in known.items():
        if s["n"] < 4:
            continue
        q1, q3 = quartiles[name]
        spread = q3 - q1
        low, high = q1 - IQR_TIMES * spread, q3 + IQR_TIMES * spread
        value = _finite(name)
        beyond = max(low - s["low"], s["high"] - high, 0.0)
        worst = beyond / spread if spread else float("inf") if beyond else 0.0
        score = F.greatest(low - value, value - high)
        tests.append(Test("iqr", name, (value < low) | (value > high), score, min(worst / 5.0, 1.0), True, f"IQR outliers in {name} (multiplier: {IQR_TIMES})"))
    return tests


def _modified_z_scores(df: DataFrame, known: dict[str, dict[str, float]], medians: dict[str, float], accuracy: int) -> list[Test]:
    """0.6745 |x - median| / MAD above 3.5; needs three values and a MAD that is not 0."""
    wanted = {c: F.abs(_finite(c) - m) for c, m in medians.items() if m is not None}
    deviations = exact_quantiles(df, wanted, [0.5], accuracy) if wanted else {}
    tests = []
    for name, (mad,) in deviations.items():
        s, mid = known[name], medians[name]
        if s["n"] < 3 or not mad:
            continue
        score = F.abs((_finite(name) - mid) * MODIFIED_Z_SCALE / mad)
        worst = MODIFIED_Z_SCALE * max(s["high"] - mid, mid - s["low"]) / mad
        tests.append(Test("modified_z_score", name, score > MODIFIED_Z_ABOVE, score, min(worst / (2 * MODIFIED_Z_ABOVE), 1.0), False, f"Modified Z-score outliers in {name}"))
    return tests


def outlier_tests(df: DataFrame, columns: Sequence[str], methods: Sequence[str] = METHODS, accuracy: int = SKETCH_ACCURACY) -> list[Test]:
    """Tests of all methods on all columns.

    The methods share their passes: one for the moments, one search for quartiles and medians
    together, one for the median deviations.
    """
    known = moments(df, columns)
    tests = _z_scores(known) if "z_score" in methods else []
    points = [p for p, method in ((0.25, "iqr"), (0.5, "modified_z_score"), (0.75, "iqr")) if method in methods]
    if not points:
        return tests
    found = exact_quantiles(df, {c: _finite(c) for c in columns}, points, accuracy)
    if "iqr" in methods:
        tests += _quartile_ranges(known, {c: [q[0], q[-1]] for c, q in found.items()})
    if "modified_z_score" in methods:
        tests += _modified_z_scores(df, known, {c: q[points.index(0.5)] for c, q in found.items()}, accuracy)
    return tests


def outlier_summary(df: DataFrame, tests: Sequence[Test], columns: Sequence[str], methods: Sequence[str] = METHODS) -> DataFrame:
    """A summary row per method and column; a test that could not run reports no anomalies."""
    by_key = {(t.method, t.column): t for t in tests}
    wanted = [(m, c) for c in columns for m in methods]
    counts = [
        F.count_if(by_key[k].condition).alias(f"n{i}") if k in by_key else F.lit(0).cast("bigint").alias(f"n{i}")
        for i, k in enumerate(wanted)
    ]
    counted = df.agg(F.count(F.lit(1)).alias("total_count"), *counts)
    cells = []
    for i, (method, column) in enumerate(wanted):
        t = by_key.get((method, column))
        severity = F.lit(t.severity if t else 0.0)
        if t and t.severity_needs_rows:
            severity = F.when(F.col(f"n{i}") > 0, severity).otherwise(0.0)
        cells.append(
            F.struct(
                F.lit(method).alias("detector_name"),
                F.lit("statistical_outlier").alias("anomaly_type"),
                F.lit(column).alias("column_name"),
                F.col(f"n{i}").alias("anomaly_count"),
                severity.alias("severity_score"),
                F.lit(t.description if t else f"{column} cannot be tested").alias("description"),
            )
        )
    return with_rate(counted.select("total_count", F.inline(F.array(*cells)))).select(*SUMMARY_COLUMNS)


def outlier_rows(df: DataFrame, tests: Sequence[Test], ids: Sequence[str]) -> DataFrame:
    """(method, column_name, value, score, ids) of every outlier; only outliers are unpivoted."""
    marks = F.array_compact(
        F.array(
            *[
                F.when(
                    t.condition,
                    F.struct(F.lit(t.method).alias("method"), F.lit(t.column).alias("column_name"), _finite(t.column).alias("value"), t.score.alias("score")),
                )
                for t in tests
            ]
        )
    )
    return df.select(F.inline(marks), *ids)


def two_sigma(df: DataFrame, column: str) -> DataFrame:
    """Rows more than two sample deviations from the mean, counted against filled rows."""
    stats = df.agg(F.struct(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")).alias("s")).scalar()
    value = F.col(column)
    return df.agg(
        F.lit(column).alias("column_name"),
        F.count(value).alias("values_checked"),
        F.count_if(F.abs(value - stats["mean"]) > 2 * stats["std"]).alias("anomaly_count"),
    )
