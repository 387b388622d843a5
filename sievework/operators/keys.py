"""Key look-ups and reference checks between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scoring import share
from sievework.operators.dedup import keep_last

NULL_SPREAD = 64
PASS_BELOW_UNMATCHED = 0.1


def resolve(df: DataFrame, lookup: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Add ``value`` from ``lookup`` by ``key``; the last duplicate wins, no match gives null.

    Rows without a key can match nothing; they are dealt out over many partitions instead of meeting
    in one.  Frequent keys are split by adaptive execution (the look-up side is unique).
    """
    unique = keep_last(lookup.filter(F.col(key).isNotNull()).select(key, value, *[c for c in order if c not in (key, value)]), [key], order)
    unique = unique.select(F.col(key).alias("_key"), F.lit(0).alias("_deal"), F.col(value).alias(f"_{value}"))
    rest = [c for c in df.columns if c not in (key, value)]
    deal = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*(rest or [key])), F.lit(NULL_SPREAD))).otherwise(0).cast("int")
    dealt = df.drop(value).withColumn("_row_deal", deal)
    joined = dealt.join(unique, (dealt[key] == unique["_key"]) & (dealt["_row_deal"] == unique["_deal"]), "left")
    return joined.select(*[c for c in df.columns if c != value], F.col(f"_{value}").alias(value))


def _per_key(df: DataFrame, key: str, name: str) -> DataFrame:
    """Row count per key; combined inside each task, so a frequent key moves one row per task."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias(name))


def consistency(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows, matched rows and rows without a parent, as a left join would count them.

    Both sides are reduced to one row per key before they meet.  Also gives match rate and PASS, or
    WARN from 10 % unmatched on.
    """
    children, parents = _per_key(child, child_key, "_rows"), _per_key(parent, parent_key, "_copies")
    joined = children.join(parents, "_key", "left")
    copies = F.coalesce("_copies", F.lit(0))
    counted = joined.agg(
        F.coalesce(F.sum(F.col("_rows") * F.greatest(copies, F.lit(1))), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("_rows") * copies), F.lit(0)).alias("matched_rows"),
    )
    counted = counted.withColumn("unmatched_rows", F.col("total_rows") - F.col("matched_rows"))
    return counted.withColumns(
        {
            "match_rate": share(F.col("matched_rows"), F.col("total_rows")),
            "status": match_status(F.col("unmatched_rows"), F.col("total_rows")),
        }
    )


def match_status(unmatched: Column, total: Column) -> Column:
    return F.when(unmatched < total * PASS_BELOW_UNMATCHED, "PASS").otherwise("WARN")


def coverage(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """How many distinct parents have at least one child."""
    parents = parent.select(F.col(parent_key).alias("_key")).filter("_key is not null").distinct()
    children = child.select(F.col(child_key).alias("_child")).filter("_child is not null").distinct()
    joined = parents.join(children, F.col("_key") == F.col("_child"), "left")
    counted = joined.agg(F.count("_key").alias("total_parents"), F.count("_child").alias("parents_with_children"))
    return counted.withColumn("coverage", share(F.col("parents_with_children"), F.col("total_parents")))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; rows without a key are no orphans."""
    keyed = child.filter(F.col(child_key).isNotNull())
    known = parent.select(F.col(parent_key).alias("_known"))
    return keyed.join(known, keyed[child_key] == known["_known"], "left_anti")


def with_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    known = parent.select(F.col(parent_key).alias("_known"))
    return child.join(known, child[child_key] == known["_known"], "left_semi")
