"""Time-series detectors and trends.

A series is given by key columns (none: the whole table) and an order that is unique within it, such
as (time, id).  Neighbour values come from offset windows over buckets of bounded length, so neither
a long series nor a table without keys ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.scoring import percent_change
from sievework.operators.detectors import with_rate
from sievework.operators.ordering import BUCKET_ROWS, bucketed, neighbours, positions, series_window

SPIKE_ABOVE = 5.0
SPIKE_POINTS = 7
TREND_JUMP = 0.8
TREND_HALF = 10
YEAR_JUMP = 10.0
TARGET_REDUCTION = 42.0
CELL_BUCKET = 100_000  # rows of a bucket where all columns of a table are series


def _filled(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    columns = list(dict.fromkeys([*keys, *order, value]))
    return df.select(*columns).filter(F.col(value).isNotNull())


def spike_scores(
    df: DataFrame, keys: list[str], order: list[str], value: str, leave_one_out: bool = False, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``z_score`` of every value against a centred window of min(7, n/3) points.

    As published the point belongs to its own window, which keeps |z| below 2.27 and the detector
    silent; ``leave_one_out`` compares it with the other points.  Values without a full window get no
    score.
    """
    placed, longest = positions(_filled(df, keys, order, value), keys, order, bucket_rows)
    half = SPIKE_POINTS // 2
    rows = bucketed(placed, longest, half, half, bucket_rows)
    rows = _reaching(rows)
    near = neighbours(F.col(value).cast("double"), series_window(keys), -half, half)
    rows = rows.withColumns({f"_v{d + half}": c for d, c in near.items()}).filter("at_home")
    rows = _with_z_score(rows, value, {d: F.col(f"_v{d + half}") for d in near}, leave_one_out)
    return rows.select(*dict.fromkeys([*keys, *order, value]), "position", "series_rows", "z_score")


def _reaching(rows: DataFrame) -> DataFrame:
    """How far the window of a spike reaches; an even one reaches one point further back than forward.

    The reach is known before the offset window, so that a filter on the score, which is pushed down to that
    window, stays short.
    """
    rows = rows.withColumn("_size", F.least(F.lit(SPIKE_POINTS), F.floor(F.col("series_rows") / 3)))
    rows = rows.withColumn("_forward", F.floor((F.col("_size") - 1) / 2))
    return rows.withColumn("_back", F.col("_size") - 1 - F.col("_forward"))


def _with_z_score(rows: DataFrame, value: str, near: dict[int, Column], leave_one_out: bool = False) -> DataFrame:
    for d, neighbour in near.items():
        inside = F.lit(False) if leave_one_out and d == 0 else F.col("_back") >= -d if d < 0 else F.col("_forward") >= d
        rows = rows.withColumn(f"_m{d}", F.when(inside, neighbour))
    members = [F.col(f"`_m{d}`") for d in near]
    zero = F.lit(0.0)
    rows = rows.withColumn("_count", reduce(add, [m.isNotNull().cast("int") for m in members]))
    rows = rows.withColumn("_middle", F.try_divide(reduce(add, [F.coalesce(m, zero) for m in members]), F.col("_count")))
    squares = reduce(add, [F.coalesce(F.pow(m - F.col("_middle"), 2), zero) for m in members])
    rows = rows.withColumn("_spread", F.sqrt(F.try_divide(squares, F.col("_count") - 1)))
    complete = (F.col("position") >= F.col("_back")) & (F.col("position") + F.col("_forward") < F.col("series_rows"))
    judged = complete & (F.col("series_rows") >= 3) & (F.col("_spread") > 0)
    return rows.withColumn("z_score", F.when(judged, (F.col(value) - F.col("_middle")) / F.col("_spread")))


def spikes(df: DataFrame, keys: list[str], order: list[str], value: str, leave_one_out: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    return spike_scores(df, keys, order, value, leave_one_out, bucket_rows).filter(F.abs("z_score") > SPIKE_ABOVE)


def trend_scores(df: DataFrame, keys: list[str], order: list[str], value: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Correlation of value and position over [i - w, i + w), w = min(10, n/2), and the one before.

    Windows of equal values have no correlation and are skipped; ``previous`` is that of the last
    window that was not skipped.
    """
    placed, longest = positions(_filled(df, keys, order, value), keys, order, bucket_rows)
    rows = bucketed(placed, longest, TREND_HALF, TREND_HALF, bucket_rows)
    near = neighbours(F.col(value).cast("double"), series_window(keys), -TREND_HALF, TREND_HALF - 1)
    rows = rows.withColumns({f"_v{d + TREND_HALF}": c for d, c in near.items()}).filter("at_home")
    rows = _with_correlation(rows, near)
    columns = list(dict.fromkeys([*keys, *order, value]))
    rows = rows.select(*columns, "position", "series_rows", "bucket", "correlation").withColumn("previous", _previous(keys))
    if longest > bucket_rows:
        rows = _carry_over(rows, keys)
    return rows.drop("bucket")


def _previous(keys: list[str]) -> Column:
    """Correlation of the last window of the bucket that was not skipped."""
    return F.last("correlation", ignorenulls=True).over(series_window(keys).rowsBetween(Window.unboundedPreceding, -1))


def _with_correlation(rows: DataFrame, near: Sequence[int]) -> DataFrame:
    """Add ``correlation`` to rows that have the values at offsets ``near`` as ``_v0`` and so on."""
    rows = rows.withColumn("_half", F.least(F.lit(TREND_HALF), F.floor(F.col("series_rows") / 2)))
    rows = rows.withColumns(
        {f"_v{d + TREND_HALF}": F.when(F.col("_half") >= (-d if d < 0 else d + 1), F.col(f"_v{d + TREND_HALF}")) for d in near}
    )
    window = {d: F.col(f"_v{d + TREND_HALF}") for d in near}
    rows = rows.withColumns(
        {
            "_mean": F.try_divide(reduce(add, [F.coalesce(v, F.lit(0.0)) for v in window.values()]), 2 * F.col("_half")),
            "_low": F.least(*window.values()),
            "_high": F.greatest(*window.values()),
        }
    )
    # Positions are centred on i - 1/2, so no large numbers are subtracted from each other.
    rows = rows.withColumns(
        {
            "_cross": reduce(add, [F.coalesce((v - F.col("_mean")) * (d + 0.5), F.lit(0.0)) for d, v in window.items()]),
            "_squares": reduce(add, [F.coalesce(F.pow(v - F.col("_mean"), 2), F.lit(0.0)) for v in window.values()]),
        }
    )
    judged = (
        (F.col("series_rows") >= 6)
        & (F.col("position") >= F.col("_half"))
        & (F.col("position") < F.col("series_rows") - F.col("_half"))
        & (F.col("_high") > F.col("_low"))
    )
    # Sum of (d + 1/2)^2 over 2w centred positions is w (4 w^2 - 1) / 6.
    time_squares = F.col("_half") * (4 * F.col("_half") * F.col("_half") - 1) / 6.0
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("_cross"), F.sqrt(time_squares * F.col("_squares")))))
    return rows.withColumn("correlation", F.when(judged, ratio))


def _carry_over(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First windows of a bucket compare with the last one of an earlier bucket (one row per bucket)."""
    ends = rows.groupBy(*keys, "bucket").agg(
        F.max_by("correlation", F.when(F.col("correlation").isNotNull(), F.col("position"))).alias("_end")
    )
    series = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    before = series.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("bucket").alias("_of_bucket"),
        F.last("_end", ignorenulls=True).over(before).alias("_carried"),
    )
    match = reduce(
        lambda a, b: a & b,
        [rows["bucket"] == ends["_of_bucket"], *[rows[k].eqNullSafe(ends[f"_of_{k}"]) for k in keys]],
    )
    joined = rows.join(ends, match, "left")
    return joined.withColumn("previous", F.coalesce("previous", "_carried")).select(*rows.columns)


def trend_changes(df: DataFrame, keys: list[str], order: list[str], value: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    jump = F.abs(F.col("correlation") - F.col("previous"))
    return trend_scores(df, keys, order, value, bucket_rows).withColumn("jump", jump).filter(F.col("jump") > TREND_JUMP)


def year_spikes(
    df: DataFrame, facility: str, order: list[str], value: str, times: float = YEAR_JUMP, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Values that grew by more than ``times`` (10 = 1000 %) over the one before, per facility.

    Facilities need three values.  Growth from 0 to something is infinite and counts; 0 to 0 does not.
    """
    placed, longest = positions(_filled(df, [facility], order, value), [facility], order, bucket_rows)
    rows = bucketed(placed, longest, 1, 0, bucket_rows)
    rows = rows.withColumn("previous_value", F.lag(value).over(series_window([facility]))).filter("at_home")
    now, before = F.col(value), F.col("previous_value")
    grown = F.when(before == 0, now > 0).otherwise(now / F.nullif(before, F.lit(0.0)) - 1 > times)
    return rows.filter((F.col("series_rows") >= 3) & grown).select(facility, *order, value, "previous_value")


def detector_summary(flagged: DataFrame, df: DataFrame, name: str, kind: str, column: str, severity: Column, description: str) -> DataFrame:
    """Summary row of a series detector; ``severity`` is an aggregate over the flagged rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    row = flagged.agg(F.count(F.lit(1)).alias("anomaly_count"), severity.alias("_severity"))
    row = row.select(
        F.lit(name).alias("detector_name"), F.lit(kind).alias("anomaly_type"), F.lit(column).alias("column_name"),
        "anomaly_count", total.alias("total_count"), F.lit(description).alias("description"), "_severity",
    )
    part = F.coalesce(F.try_divide(F.col("anomaly_count"), F.col("total_count")), F.lit(0.0))
    return with_rate(row.withColumn("severity_score", F.least(F.coalesce("_severity", part), F.lit(1.0))))


def series_summaries(
    df: DataFrame, order: list[str], values: Sequence[str], keys: list[str] | None = None, bucket_rows: int = CELL_BUCKET
) -> DataFrame:
    """Spike and trend summaries of every value column.

    The columns become series of one long frame, (column, value) under the row's order.  All of them are placed once, and
    both detectors score them in one pass over buckets: the plan and the number of jobs stay the same however many columns
    there are, and few long series still make many tasks.
    """
    keys, zero = keys or [], F.lit(0.0)
    cells = [F.struct(F.lit(v).alias("_column"), F.col(v).cast("double").alias("_value")) for v in values]
    long = df.select(*dict.fromkeys([*keys, *order]), F.inline(F.array(*cells)))
    series_keys = [*keys, "_column"]
    found = _hits(long, series_keys, order, bucket_rows)
    counted = df.agg(F.count(F.lit(1)).alias("total_count"), *[F.count(v).alias(f"_n{i}") for i, v in enumerate(values)])
    rows = [
        F.struct(
            F.lit(name).alias("detector_name"), F.lit(kind).alias("anomaly_type"), F.lit(v).alias("column_name"),
            F.lit(f"{text} in {v}").alias("description"), F.col(f"_n{i}").alias("_filled"),
        )
        for i, v in enumerate(values)
        for name, kind, text in (("spike_detection", "time_series_spike", "Time series spikes/drops"), ("trend_change", "trend_change", "Trend changes"))
    ]
    listed = counted.select("total_count", F.inline(F.array(*rows)))
    met = listed.join(found, (F.col("detector_name") == F.col("_detector")) & (F.col("column_name") == F.col("_column")), "left")
    met = met.withColumn("anomaly_count", F.coalesce("_hits", F.lit(0).cast("bigint")))
    share_of_filled = F.coalesce(F.try_divide(F.col("anomaly_count"), F.col("_filled")), zero)
    severity = F.when(F.col("detector_name") == "spike_detection", F.coalesce("_worst", zero)).otherwise(share_of_filled)
    return with_rate(met.withColumn("severity_score", F.least(severity, F.lit(1.0))))


def _hits(long: DataFrame, keys: list[str], order: list[str], bucket_rows: int) -> DataFrame:
    """``_column, _detector, _hits, _worst``: what :func:`spikes` and :func:`trend_changes` find in ``_value``, counted."""
    placed, longest = positions(_filled(long, keys, order, "_value"), keys, order, bucket_rows)
    rows = _reaching(bucketed(placed, longest, TREND_HALF, TREND_HALF, bucket_rows))
    near = neighbours(F.col("_value"), series_window(keys), -TREND_HALF, TREND_HALF - 1)
    rows = rows.withColumns({f"_v{d + TREND_HALF}": c for d, c in near.items()}).filter("at_home")
    half = SPIKE_POINTS // 2
    rows = _with_z_score(rows, "_value", {d: F.col(f"_v{d + TREND_HALF}") for d in range(-half, half + 1)})
    rows = _with_correlation(rows, near).select(*keys, "bucket", "position", F.abs("z_score").alias("_z"), "correlation").withColumn("previous", _previous(keys))
    # The first window of a bucket compares with the last one of an earlier bucket: on one row per bucket.
    place = F.when(F.col("correlation").isNotNull(), F.col("position"))
    ends = rows.groupBy(*keys, "bucket").agg(
        F.count_if(F.col("_z") > SPIKE_ABOVE).alias("_spikes"), F.max(F.when(F.col("_z") > SPIKE_ABOVE, F.col("_z"))).alias("_high_z"),
        F.count_if(F.abs(F.col("correlation") - F.col("previous")) > TREND_JUMP).alias("_changes"),
        F.min_by("correlation", place).alias("_start"), F.max_by("correlation", place).alias("_end"),
    )
    before = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    over = F.abs(F.col("_start") - F.last("_end", ignorenulls=True).over(before)) > TREND_JUMP
    summed = ends.withColumn("_over", over).groupBy("_column").agg(
        F.sum("_spikes").alias("_spikes"), F.max("_high_z").alias("_high_z"), (F.sum("_changes") + F.count_if("_over")).alias("_changes")
    )
    cells = [
        F.struct(F.lit("spike_detection").alias("_detector"), F.col("_spikes").alias("_hits"), (F.col("_high_z") / (2 * SPIKE_ABOVE)).alias("_worst")),
        F.struct(F.lit("trend_change").alias("_detector"), F.col("_changes").alias("_hits"), F.lit(None).cast("double").alias("_worst")),
    ]
    return summed.select("_column", F.inline(F.array(*cells)))


def trend(df: DataFrame, keys: list[str], order: list[str], value: str, stable_within: float = 1.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Linear trend over the points of each series: slope per step, direction, level and spread."""
    placed, _ = positions(_filled(df, keys, order, value), keys, order, bucket_rows)
    y, x = F.col(value).cast("double"), F.col("position").cast("double")
    fitted = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.max_by(y, "position").alias("current_value"),
        F.min(y).alias("min_value"),
        F.max(y).alias("max_value"),
        F.avg(y).alias("average_value"),
        F.stddev_pop(y).alias("volatility"),
    )
    direction = F.when(F.col("slope") > stable_within, "improving").when(F.col("slope") < -stable_within, "declining").otherwise("stable")
    return fitted.filter("points >= 2").withColumn("trend_direction", direction)


def forecast(trends: DataFrame, keys: list[str], periods: int = 3) -> DataFrame:
    """The next points on the trend line, kept within 0..100; needs three points."""
    steps = trends.filter("points >= 3").withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    line = F.col("slope") * (F.col("points") + F.col("period") - 1) + F.col("intercept")
    return steps.select(*keys, F.col("period").cast("bigint").alias("period"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), line)).alias("forecast_score"), "slope")


def first_to_last(df: DataFrame, time: str, score: str, error_rate: str) -> DataFrame:
    """Score gain and error reduction between the first and the last period."""
    ends = df.agg(
        F.min(time).alias("period_start"), F.max(time).alias("period_end"), F.count(F.lit(1)).alias("periods"),
        F.min_by(score, time).alias("first_score"), F.max_by(score, time).alias("last_score"),
        F.min_by(error_rate, time).alias("first_rate"), F.max_by(error_rate, time).alias("last_rate"),
    ).filter("periods >= 2")
    reduction = -percent_change(F.col("first_rate"), F.col("last_rate"))
    return ends.select(
        "period_start", "period_end",
        (F.col("last_score") - F.col("first_score")).alias("quality_gain"),
        percent_change(F.col("first_score"), F.col("last_score")).alias("quality_gain_percent"),
        (F.col("first_rate") - F.col("last_rate")).alias("error_reduction"),
        reduction.alias("error_reduction_percent"),
        (reduction >= TARGET_REDUCTION).alias("target_met"),
    )
