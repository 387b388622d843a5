"""Exact quantiles of columns of any length, in two scans.

The first scan makes one mergeable sketch for each column.  A sketch is off by a known share of the rows at
most, so it names for every wanted rank a bracket of values that holds it.  The second scan maps each value to the gap
or bracket it falls in; gaps are only counted, values in brackets are counted one by one, both combined inside each
task.  What is left, a few rows in ten thousand, is range partitioned, and a rank is looked up in the one partition
where the running count passes it.  No step holds a column, or a bracket, in one task.

The result does not depend on how good the sketch is: a rank that falls into a gap widens its bracket, which costs one
more scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.session import settle

SKETCH_ACCURACY = 10_000

Bracket = tuple[float | None, float | None]


def _ranks(probability: float, rows: int) -> tuple[int, int]:
    place = probability * (rows - 1)
    return math.floor(place), math.ceil(place)


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probabilities: Sequence[float], accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation; nulls are ignored. Collects one row, and one for each rank."""
    rows, brackets = _sketched(df, columns, probabilities, accuracy)
    wanted = {n: sorted({r for p in probabilities for r in _ranks(p, rows[n])}) for n in columns if rows[n]}
    found: dict[tuple[str, int], float] = {}
    while missing := {n: left for n, ranks in wanted.items() if (left := [r for r in ranks if (n, r) not in found])}:
        answers = _looked_up(df, {n: columns[n] for n in missing}, {n: brackets[n] for n in missing}, missing)
        found.update({(name, rank): value for name, rank, value, slot in answers if slot % 2})
        for name, slot in sorted({(name, slot) for name, _, _, slot in answers if slot % 2 == 0}, reverse=True):
            brackets[name] = _without_gap(brackets[name], slot)
    result: dict[str, list[float | None]] = {}
    for name in columns:
        result[name] = [None] * len(probabilities)
        for i, p in enumerate(probabilities if rows[name] else ()):
            lower, upper = _ranks(p, rows[name])
            part = p * (rows[name] - 1) - lower
            a, b = found[name, lower], found[name, upper]
            result[name][i] = a if lower == upper else (1 - part) * a + part * b
    return result


def _sketched(df, columns, probabilities, accuracy) -> tuple[dict[str, int], dict[str, list[Bracket]]]:
    """Filled rows and brackets of every column, from one scan."""
    reach = 2 / accuracy
    points = [q for p in probabilities for q in (max(p - reach, 0.0), min(p + reach, 1.0))]
    sketch = lambda c: F.percentile_approx(c, F.array(*[F.lit(q) for q in points]), F.lit(accuracy))
    measures = [m for i, c in enumerate(columns.values()) for m in (F.count(c).alias(f"n{i}"), sketch(c.cast("double")).alias(f"s{i}"))]
    row = df.agg(*measures).first()
    rows, brackets = {}, {}
    for i, name in enumerate(columns):
        rows[name] = row[f"n{i}"]
        if rows[name] <= 2 * accuracy:  # the sketch's share is less than a row: one bracket for all
            brackets[name] = [(None, None)]
            continue
        ends = row[f"s{i}"]
        brackets[name] = _joined([(None if p <= reach else ends[2 * k], None if p >= 1 - reach else ends[2 * k + 1]) for k, p in enumerate(probabilities)])
    return rows, brackets


def _joined(brackets: list[Bracket]) -> list[Bracket]:
    """Disjoint brackets in ascending order; a missing end is open."""
    start = lambda b: -math.inf if b[0] is None else b[0]
    out: list[Bracket] = []
    for low, high in sorted(brackets, key=start):
        if out and (out[-1][1] is None or low is None or low <= out[-1][1]):
            before = out[-1]
            out[-1] = (before[0], None if before[1] is None or high is None else max(before[1], high))
        else:
            out.append((low, high))
    return out


def _without_gap(brackets: list[Bracket], slot: int) -> list[Bracket]:
    """Brackets in which the gap ``slot`` is closed, by joining what lies on both of its sides."""
    at = slot // 2
    low = brackets[at - 1][0] if at else None
    high = brackets[at][1] if at < len(brackets) else None
    return [*brackets[: max(at - 1, 0)], (low, high), *brackets[at + 1 :]]


def _slot(value: Column, brackets: list[Bracket]) -> Column:
    """The number of the gap (even) or bracket (odd) that ``value`` falls in."""
    slot = F.lit(2 * len(brackets))
    for i, (low, high) in reversed(list(enumerate(brackets))):
        slot = F.when(value <= high, 2 * i + 1).otherwise(slot) if high is not None else F.lit(2 * i + 1)
        slot = F.when(value < low, 2 * i).otherwise(slot) if low is not None else slot
    return slot


def _looked_up(df, columns, brackets, ranks) -> list[tuple[str, int, float, int]]:
    """(column, rank, value, slot) of the wanted ranks; one scan of ``df``, then work on what lies in brackets."""
    names = list(columns)
    cells = []
    for i, name in enumerate(names):
        value = columns[name].cast("double")
        slot = _slot(value, brackets[name])
        cells.append(F.when(value.isNotNull(), F.struct(F.lit(i).alias("of"), slot.alias("slot"), F.when(slot % 2 == 1, value).alias("value"))))
    counted = df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("of", "slot", "value").agg(F.count(F.lit(1)).alias("n"))
    laid = settle(settle(counted).repartitionByRange("of", "slot", "value").withColumn("part", F.spark_partition_id()))
    sums = laid.groupBy("of", "part").agg(F.sum("n").alias("held"))
    earlier = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    asked = F.array(*[F.struct(F.lit(i).alias("of"), F.lit(r).cast("long").alias("rank")) for i, n in enumerate(names) for r in ranks[n]])
    asked = df.sparkSession.range(1).select(F.inline(asked))
    at = asked.join(sums, "of").filter("before <= rank AND rank < before + held").select("of", "part", "rank", "before")
    upto = Window.partitionBy("of", "rank").orderBy("slot", "value")
    met = laid.join(at, ["of", "part"]).withColumn("reached", F.col("before") + F.sum("n").over(upto))
    hit = met.filter("rank >= reached - n AND rank < reached").select("of", "rank", "value", "slot").collect()
    return [(names[r["of"]], r["rank"], r["value"], r["slot"]) for r in hit]


def quantile(df: DataFrame, column: Column, probability: float) -> float | None:
    return exact_quantiles(df, {"q": column}, [probability])["q"][0]


def median(df: DataFrame, column: Column) -> float | None:
    return quantile(df, column, 0.5)
