"""Leakage-safe assignment of documents to dev and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_split(groups: DataFrame, stratum: str, unit: str, size: str, share: float = 0.6) -> DataFrame:
    """Units in descending size fill dev until the quota of their stratum is reached; the rest is test.

    Dev is a prefix of that order, so a running sum decides it. `groups` has one row per unit.
    """
    order = Window.partitionBy(stratum).orderBy(F.desc(size), unit)
    before = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    total = F.sum(size).over(Window.partitionBy(stratum))
    return groups.withColumn("split", F.when(before < F.bround(total * F.lit(share)), "dev").otherwise("test"))


def stratified_split(groups: DataFrame, stratum: str, unit: str, seed: str, share: float = 0.6) -> DataFrame:
    """The first units of each stratum by a seeded hash are dev; strata of two or more have both sides."""
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(seed), F.col(unit)), 256), unit)
    n = F.count(F.lit(1)).over(Window.partitionBy(stratum))
    dev = F.when(n == 1, n).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(share)))))
    return groups.withColumn("split", F.when(F.row_number().over(order) <= dev, "dev").otherwise("test"))


def group_key(text: Column, content_hash: Column) -> Column:
    """Duplicate text first, then duplicate content."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("gt:"), F.substring(F.sha1(text.cast("binary")), 1, 12))).otherwise(
        F.concat(F.lit("px:"), F.substring(content_hash, 1, 12))
    )


def leaks(rows: DataFrame, unit: str, split: str = "split") -> DataFrame:
    """Units that stand on more than one side."""
    return rows.groupBy(unit).agg(F.count_distinct(split).alias("sides")).filter("sides > 1")
