"""Rule engine: any number of validation rules in one scan.

A rule is a name, a condition that is true for a failing row, and attributes.  Conditions are
Columns or SQL text, so users add rules without writing functions.  Null conditions do not fail.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.scoring import share

CRITICAL, WARNING, INFO = "CRITICAL", "WARNING", "INFO"
SAMPLE_IDS = 10


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column | str
    severity: str = WARNING
    message: str = ""
    column: str | None = None
    finding_type: str = "OUT_OF_RANGE"
    group: str = "business"  # required, type, business, cross

    @property
    def condition(self) -> Column:
        return F.expr(self.fails) if isinstance(self.fails, str) else self.fails


def evaluate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: failed and total counts, error rate, severity, message.

    One aggregate with one conditional count per rule; its single row is then turned into rows.  A
    rule that passes reports severity INFO and no message.
    """
    if not rules:
        raise ValueError("no rules given")
    counted = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(r.condition).alias(f"r{i}") for i, r in enumerate(rules)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule_name"),
                F.lit(r.group).alias("rule_group"),
                F.lit(r.column).cast("string").alias("column_name"),
                F.lit(r.finding_type).alias("finding_type"),
                F.lit(r.severity).alias("declared_severity"),
                F.lit(r.message).alias("message"),
                F.col(f"r{i}").alias("failed_count"),
            )
            for i, r in enumerate(rules)
        ]
    )
    listed = counted.select(F.col("total").alias("total_count"), F.inline(rows))
    passed = F.col("failed_count") == 0
    return listed.select(
        "rule_name",
        "rule_group",
        "column_name",
        "finding_type",
        F.when(passed, INFO).otherwise(F.col("declared_severity")).alias("severity"),
        passed.alias("passed"),
        "failed_count",
        "total_count",
        share(F.col("failed_count"), F.col("total_count")).alias("error_rate"),
        F.when(passed, "").otherwise(F.col("message")).alias("error_message"),
    )


def failing_rows(df: DataFrame, rules: Sequence[Rule], ids: list[str]) -> DataFrame:
    """(rule_name, ids) of every failing row; a row appears once per rule it fails."""
    names = F.array_compact(F.array(*[F.when(r.condition, F.lit(r.name)) for r in rules]))
    return df.select(F.explode(names).alias("rule_name"), *ids)


def sample_failures(df: DataFrame, rules: Sequence[Rule], ids: list[str], count: int = SAMPLE_IDS) -> DataFrame:
    """The first ``count`` failing rows per rule, by id.

    Every task cuts its list to ``count`` per rule before the shuffle, so a rule that fails everywhere
    moves ``count`` rows per task.
    """
    ranked = Window.partitionBy("rule_name").orderBy(*ids)
    return failing_rows(df, rules, ids).withColumn("sample_no", F.row_number().over(ranked)).filter(F.col("sample_no") <= count)


def summary(results: DataFrame) -> DataFrame:
    """One row over rule results: checks, pass rate, severities, failures."""
    checks, passed = F.count(F.lit(1)), F.count_if(F.col("passed"))
    totals = results.agg(
        checks.alias("total_checks"),
        passed.alias("passed_checks"),
        (checks - passed).alias("failed_checks"),
        F.count_if(F.col("severity") == CRITICAL).alias("critical_count"),
        F.count_if(F.col("severity") == WARNING).alias("warning_count"),
        F.count_if(F.col("severity") == INFO).alias("info_count"),
        F.floor(F.try_divide(F.sum("total_count"), checks)).alias("records_validated"),
        F.sum("failed_count").alias("record_failures"),
    )
    return totals.withColumns(
        {
            "overall_pass_rate": share(F.col("passed_checks"), F.col("total_checks")),
            "overall_error_rate": share(F.col("failed_checks"), F.col("total_checks")),
            "record_failure_rate": share(F.col("record_failures"), F.col("records_validated")),
        }
    )


def top_failures(results: DataFrame, count: int = 10) -> DataFrame:
    """Failed rules by error rate, highest first."""
    failed = results.filter(~F.col("passed"))
    return failed.orderBy(F.col("error_rate").desc(), "rule_name").limit(count).select(
        "rule_name", "error_rate", "failed_count", "error_message"
    )


def breakdown(df: DataFrame, issues: dict[str, Column | str]) -> DataFrame:
    """Issue counts and shares, plus the rate over all (row, issue) pairs in every row."""
    results = evaluate(df, [Rule(name, condition) for name, condition in issues.items()])
    everything = Window.partitionBy(F.lit(1))  # one row per issue
    return results.select(
        F.col("rule_name").alias("issue"),
        "failed_count",
        F.col("error_rate").alias("issue_rate"),
        share(F.sum("failed_count").over(everything), F.sum("total_count").over(everything)).alias("overall_error_rate"),
    )
