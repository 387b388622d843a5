"""Quality dimensions of a dataset, the overall score, and comparisons between scores."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import codes
from sievework.functions.parsing import DATE_SHAPES, date_shape, to_date_flexible
from sievework.functions.scoring import fine_grade, flag, letter_grade, percent_change, share
from sievework.functions.text import has_token
from sievework.operators.cleaning import coordinate_pair

CURRENT_DAYS = 30
TARGET_IMPROVEMENT = 42.0
DIMENSIONS = tuple(codes.QUALITY_WEIGHTS)


def _rows() -> Column:
    return F.count(F.lit(1))


def _fixed(total: Column, columns: Sequence[str]) -> Column:
    """Mean share of non-null values over ``columns``."""
    if not columns:
        return F.lit(0.0)
    return reduce(add, [share(F.count(F.col(c)), total) for c in columns]) / len(columns)


def _all_present(columns: Sequence[str]) -> Column:
    return F.count_if(reduce(and_, [F.col(c).isNotNull() for c in columns], F.lit(True)))


def column_completeness(df: DataFrame) -> DataFrame:
    """(column_name, non_null, total, completeness) in one pass."""
    counted = df.agg(_rows().alias("total_records"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("non_null")) for c in df.columns])
    return counted.select("total_records", F.inline(cells)).withColumn(
        "completeness", share(F.col("non_null"), F.col("total_records"))
    )


def completeness(df: DataFrame, required: Sequence[str] | None = None) -> DataFrame:
    """Mean column completeness and complete rows, over the required columns or all of them."""
    looked_at = [c for c in required if c in df.columns] if required else df.columns
    return df.agg(
        _rows().alias("total_records"),
        _all_present(looked_at).alias("complete_records"),
        _fixed(_rows(), looked_at).alias("completeness_score"),
    )


def accuracy_of_rules(results: DataFrame) -> DataFrame:
    """Accuracy from rule results: all passed tests over all tests; errors spread over the rules."""
    total, failed = F.sum("total_count"), F.sum("failed_count")
    return results.agg(
        F.max("total_count").alias("total_records"),
        (F.max("total_count") - F.floor(failed / _rows())).alias("valid_records"),
        F.when(total > 0, (total - failed) / total * 100.0).otherwise(100.0).alias("accuracy_score"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _numbers_valid(df: DataFrame) -> Column:
    return _all_present(numeric_columns(df))


def accuracy(df: DataFrame) -> DataFrame:
    """Accuracy without rules: rows whose numeric columns are all filled."""
    return df.agg(
        _rows().alias("total_records"),
        _numbers_valid(df).alias("valid_records"),
        F.when(_rows() > 0, _numbers_valid(df) * 100.0 / _rows()).otherwise(0.0).alias("accuracy_score"),
    )


def crossed(first: str, second: str) -> Column:
    """Violations of "first is below second"."""
    return F.count_if(F.col(first) >= F.col(second))


def mixed_formats(column: str) -> Column:
    """Rows outside the most frequent date format; 0 when only one format occurs."""
    shape = date_shape(F.col(column))
    counts = [F.count_if(shape == label) for label in [s for _, s in DATE_SHAPES] + ["OTHER"]]
    kinds = reduce(add, [(c > 0).cast("int") for c in counts])
    return F.when(kinds > 1, _rows() - F.greatest(*counts)).otherwise(F.lit(0))


def default_inconsistencies(df: DataFrame) -> list[Column]:
    """Half-filled coordinates, and state codes that are not upper case."""
    tests = []
    latitude, longitude = coordinate_pair(df.columns)
    if latitude and longitude:
        tests.append(F.count_if(F.col(latitude).isNull() != F.col(longitude).isNull()))
    for entry in df.schema.fields:
        if has_token(entry.name, "state") and isinstance(entry.dataType, T.StringType):
            tests.append(F.count_if(F.col(entry.name) != F.upper(entry.name)))
    return tests


def _violations(df: DataFrame, violations: Sequence[Column] | None) -> Column:
    return reduce(add, violations if violations is not None else default_inconsistencies(df), F.lit(0))


def consistency(df: DataFrame, violations: Sequence[Column] | None = None) -> DataFrame:
    """Rows minus violations (a row may count twice; never below 0).

    ``violations`` are aggregate columns such as :func:`crossed` and :func:`mixed_formats`; the
    default checks coordinates and state codes.
    """
    counted = df.agg(_rows().alias("total_records"), _violations(df, violations).cast("bigint").alias("consistency_violations"))
    left = F.greatest(F.lit(0), F.col("total_records") - F.col("consistency_violations"))
    return counted.withColumns({"consistent_records": left, "consistency_score": share(left, F.col("total_records"))})


def _distinct_rows(columns: Sequence[str]) -> Column:
    # Inside a struct nulls count as values; a plain multi-column distinct count would drop them.
    return F.count_distinct(F.struct(*[F.col(c) for c in columns]))


def uniqueness(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Distinct keys (or whole rows) against all rows."""
    present = [c for c in keys if c in df.columns] if keys else df.columns
    counted = df.agg(_rows().alias("total_records"), (_distinct_rows(present) if present else _rows()).alias("unique_records"))
    return counted.withColumns(
        {
            "uniqueness_score": share(F.col("unique_records"), F.col("total_records")),
            "duplicate_count": F.col("total_records") - F.col("unique_records"),
        }
    )


def _newest(df: DataFrame, columns: Sequence[str]) -> Column:
    """The newest readable moment of a row; null when none is readable."""
    moments = [(to_date_flexible(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c)).cast("timestamp") for c in columns]
    return F.greatest(*moments) if len(moments) > 1 else moments[0]


def _age_days(df: DataFrame, columns: Sequence[str], as_of: datetime) -> Column:
    """Whole days between a row's newest date and ``as_of``, rounded down; null when unreadable."""
    return F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(_newest(df, columns))) / 86_400_000_000)


def _current(df: DataFrame, columns: Sequence[str], as_of: datetime, days: int) -> Column:
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(_newest(df, columns))
    return F.count_if(age <= days * 86_400_000_000)


def date_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if has_token(c, "date", "time")]


def timeliness(df: DataFrame, as_of: datetime, dates: Sequence[str] | None = None, days: int = CURRENT_DAYS) -> DataFrame:
    """Share of rows at most ``days`` old among the rows with a readable date; of several ``dates`` a row's newest counts.

    By default the first date column is looked at: which others tell when a row was last true (and not when it
    expires), only the caller knows.  Future dates count as current.  Without a date column everything is current.
    """
    found = [c for c in dates if c in df.columns] if dates else date_columns(df)[:1]
    if not found:
        return df.agg(
            _rows().alias("total_records"), _rows().alias("current_records"),
            F.when(_rows() > 0, 100.0).otherwise(0.0).alias("timeliness_score"), F.lit(0.0).alias("avg_data_age_days"),
        )
    age = _age_days(df, found, as_of)
    current = _current(df, found, as_of, days)
    return df.agg(
        _rows().alias("total_records"),
        current.alias("current_records"),
        share(current, F.count(age)).alias("timeliness_score"),
        F.coalesce(F.avg(age), F.lit(0.0)).alias("avg_data_age_days"),
    )


def _slots(value: Column, kind: T.DataType) -> tuple[Column | None, Column | None, Column | None]:
    """A value as whole number, double or text, whichever keeps different values of its type different."""
    if isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("bigint"), None, None
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint"), None, None
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value), None, None
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return None, value.cast("double"), None
    if isinstance(kind, T.BinaryType):
        return None, None, F.hex(value)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return None, None, F.when(value.isNotNull(), F.to_json(F.struct(value), {"ignoreNullFields": "false"}))
    return None, None, value.cast("string")


def _value_counts(df: DataFrame) -> DataFrame:
    """One row: ``total_records`` and, of the i-th column, filled ``n<i>``, valid ``v<i>`` and distinct ``d<i>``.

    Every cell becomes a pair (column, value) of fixed width, and equal pairs are counted together inside each task
    before they are shuffled: a row is never copied whole for each column, however many there are.
    """
    kinds = ("bigint", "double", "string")
    cells = []
    for i, entry in enumerate(df.schema.fields):
        slots = _slots(F.col(f"`{entry.name}`"), entry.dataType)
        cells.append(F.struct(F.lit(i).alias("_i"), *[(F.lit(None) if v is None else v).cast(k).alias(f"_{k}") for v, k in zip(slots, kinds)]))
    pairs = df.select(F.inline(F.array(*cells))).groupBy("_i", *[f"_{k}" for k in kinds]).agg(_rows().alias("_rows"))
    texts = [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    filled = reduce(or_, [F.col(f"_{k}").isNotNull() for k in kinds])
    valid = filled & (~F.col("_i").isin(texts) | (F.length(F.trim("_string")) > 0)) if texts else filled
    by_column = pairs.groupBy("_i").agg(
        F.sum("_rows").alias("total"), F.sum(F.when(filled, F.col("_rows"))).alias("n"), F.sum(F.when(valid, F.col("_rows"))).alias("v"), F.count_if(filled).alias("d")
    )
    measures = [F.coalesce(F.max("total"), F.lit(0)).alias("total_records")]
    measures += [F.coalesce(F.max(F.when(F.col("_i") == i, F.col(m))), F.lit(0)).alias(f"{m}{i}") for i in range(len(df.columns)) for m in "nvd"]
    return by_column.agg(*measures)


def _sketched_counts(df: DataFrame) -> DataFrame:
    """The same row with approximate distinct counts; no value is shuffled."""
    measures: list[Column] = [_rows().alias("total_records")]
    for i, entry in enumerate(df.schema.fields):
        value = F.col(f"`{entry.name}`")
        valid = F.count_if(F.length(F.trim(value)) > 0) if isinstance(entry.dataType, T.StringType) else F.count(value)
        measures += [F.count(value).alias(f"n{i}"), valid.alias(f"v{i}"), F.approx_count_distinct(value).alias(f"d{i}")]
    return df.agg(*measures)


def column_scores(df: DataFrame, approximate: bool = False) -> DataFrame:
    """0.4 completeness + 0.4 validity + 0.2 uniqueness per column, at most 100.

    Text is valid when not blank; other types are valid when present.  ``approximate`` swaps the exact
    distinct counts, the only part that shuffles values, for sketches.
    """
    counted = _sketched_counts(df) if approximate or not df.columns else _value_counts(df)
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    cells = []
    for i, name in enumerate(df.columns):
        full = share(F.col(f"n{i}"), F.col("total_records"))
        # A column without any value has no valid text, but a numeric one is valid by definition.
        valid = share(F.col(f"v{i}"), F.col(f"n{i}")) if name in texts else F.lit(100.0)
        unique = share(F.col(f"d{i}"), F.col("total_records"))
        score = F.least(F.lit(100.0), full * 0.4 + valid * 0.4 + unique * 0.2)
        cells.append(F.struct(F.lit(name).alias("column_name"), full.alias("completeness"), valid.alias("validity"), unique.alias("uniqueness"), score.alias("column_score")))
    return counted.select(F.inline(F.array(*cells)))


def overall(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted score over the five dimension columns and its letter."""
    weights = weights or codes.QUALITY_WEIGHTS
    total = reduce(add, [F.col(f"{d}_score") * w for d, w in weights.items()])
    return scores.withColumn("overall_quality_score", total).withColumn("quality_grade", letter_grade(F.col("overall_quality_score")))


def quality(
    df: DataFrame,
    dataset: str,
    as_of: datetime,
    required: Sequence[str] | None = None,
    keys: Sequence[str] | None = None,
    dates: Sequence[str] | None = None,
    results: DataFrame | None = None,
) -> DataFrame:
    """All five dimensions, the overall score and the grade as one row, from one scan.

    The distinct count of the keys is the only measure that shuffles; duplicates are combined inside
    each task first.  With rule ``results`` accuracy comes from them.
    """
    looked_at = [c for c in required if c in df.columns] if required else df.columns
    keyed = [c for c in keys if c in df.columns] if keys else df.columns
    found = [c for c in dates if c in df.columns] if dates else date_columns(df)[:1]
    measures = {
        "total_records": _rows(),
        "complete_records": _all_present(looked_at),
        "completeness_score": _fixed(_rows(), looked_at),
        "valid_records": _numbers_valid(df),
        "consistency_violations": _violations(df, None).cast("bigint"),
        "unique_records": _distinct_rows(keyed) if keyed else _rows(),
        "current_records": _current(df, found, as_of, CURRENT_DAYS) if found else _rows(),
        "dated_records": F.count(_age_days(df, found, as_of)) if found else _rows(),
    }
    row = df.agg(*[c.alias(n) for n, c in measures.items()])
    total = F.col("total_records")
    left = F.greatest(F.lit(0), total - F.col("consistency_violations"))
    row = row.withColumns(
        {
            "accuracy_score": share(F.col("valid_records"), total),
            "consistent_records": left,
            "consistency_score": share(left, total),
            "uniqueness_score": share(F.col("unique_records"), total),
            "timeliness_score": share(F.col("current_records"), F.col("dated_records")),
        }
    )
    if results is not None:
        judged = accuracy_of_rules(results).select(F.struct("valid_records", "accuracy_score")).scalar()
        row = row.withColumns({"valid_records": judged["valid_records"], "accuracy_score": judged["accuracy_score"]})
    row = overall(row)
    return row.select(
        F.lit(dataset).alias("dataset_name"), "total_records", "complete_records", "completeness_score",
        "valid_records", "accuracy_score", "consistent_records", "consistency_score", "unique_records",
        "uniqueness_score", "current_records", "timeliness_score", "overall_quality_score", "quality_grade",
    )


def grade_rank(grade: Column) -> Column:
    """A is best; comparing the letters themselves would call A -> B an improvement."""
    return F.array_position(F.array(*[F.lit(letter) for letter in "FDCBA"]), grade)


def improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Gains per dimension and overall between two score frames, matched by dataset."""
    old, new = before.alias("b"), after.alias("a")
    joined = old.join(new, F.col("b.dataset_name") == F.col("a.dataset_name"))
    parts = [*DIMENSIONS, "overall"]
    names = {d: f"{d}_score" for d in DIMENSIONS} | {"overall": "overall_quality_score"}
    cells = F.array(
        *[
            F.struct(
                F.lit(p).alias("dimension"),
                (F.col(f"a.{names[p]}") - F.col(f"b.{names[p]}")).alias("absolute_gain"),
                percent_change(F.col(f"b.{names[p]}"), F.col(f"a.{names[p]}")).alias("percent_gain"),
            )
            for p in parts
        ]
    )
    gained = percent_change(F.col("b.overall_quality_score"), F.col("a.overall_quality_score"))
    return joined.select(
        F.col("b.dataset_name").alias("dataset_name"),
        F.col("b.quality_grade").alias("grade_before"),
        F.col("a.quality_grade").alias("grade_after"),
        (grade_rank(F.col("a.quality_grade")) > grade_rank(F.col("b.quality_grade"))).alias("grade_improved"),
        (gained >= TARGET_IMPROVEMENT).alias("target_met"),
        F.inline(cells),
    )


def grade_histogram(scores: DataFrame) -> DataFrame:
    """Datasets per grade with the mean score."""
    return scores.groupBy("quality_grade").agg(
        _rows().alias("datasets"), F.avg("overall_quality_score").alias("average_quality_score")
    )


def score_history(scores: DataFrame, time: str) -> DataFrame:
    """Scores in time order, for a chart."""
    columns = ("completeness_score", "accuracy_score", "consistency_score")
    return scores.select(time, "dataset_name", "overall_quality_score", *columns).orderBy(time, "dataset_name")


def weighted_check(
    df: DataFrame, filled: Sequence[str], valid: Sequence[Column], needs: Column, satisfied: Column
) -> DataFrame:
    """Short score 0.4 completeness + 0.4 validity + 0.2 consistency with fine grades.

    ``valid`` are row conditions; consistency is the share of rows with ``needs`` that are also
    ``satisfied``, 100 when none needs it.
    """
    total = _rows()
    validity = reduce(add, [share(F.count_if(v), total) for v in valid]) / len(valid)
    asked = F.count_if(needs)
    kept = F.when(asked > 0, F.count_if(needs & flag(satisfied)) * 100.0 / asked).otherwise(100.0)
    row = df.agg(
        _fixed(total, [c for c in filled if c in df.columns]).alias("completeness"),
        validity.alias("validity"),
        kept.alias("consistency"),
    )
    score = F.col("completeness") * 0.4 + F.col("validity") * 0.4 + F.col("consistency") * 0.2
    return row.withColumn("overall_quality", score).withColumn("grade", fine_grade(F.col("overall_quality")))
