"""Training ledgers, run comparison and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row(rows: DataFrame, score: str, order: str) -> DataFrame:
    """The row with the smallest score, the first in `order` on ties; rows without a score are skipped."""
    picked = rows.filter(F.col(score).isNotNull()).agg(F.min_by(F.struct(*rows.columns), F.struct(score, order)).alias("r"))
    return picked.filter("r is not null").select("r.*")


def best_so_far(rows: DataFrame, score: str, order: str, key: str | None = None) -> DataFrame:
    """Add best (running minimum), is_best and worse_runs: rows since the last improvement.

    Ledgers are one row per segment of a run; `key` separates runs.
    """
    part = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    line = part.orderBy(order)
    before = F.min(score).over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns(
        {
            "best": F.min(score).over(line),
            "is_best": F.col(score).isNotNull() & (before.isNull() | (F.col(score) < before)),
            "_n": F.row_number().over(line),
        }
    )
    last = F.max(F.when(F.col("is_best"), F.col("_n"))).over(line)
    return rows.withColumn("worse_runs", (F.col("_n") - F.coalesce(last, F.lit(0))).cast("int")).drop("_n")


def compare_runs(runs: DataFrame, run: str, metrics: list[str], keys: list[str]) -> DataFrame:
    """Each run's metrics with their change from the run before."""
    line = Window.partitionBy(*keys).orderBy(run)
    return runs.withColumns({f"d_{m}": F.bround(F.col(m) - F.lag(m).over(line), 4) for m in metrics})


def gate(metrics: DataFrame, baseline: DataFrame, slack: Column, higher_is_better: Column) -> DataFrame:
    """Metrics against a baseline (name, base): passed, unless worse by more than the slack."""
    worse = F.when(higher_is_better, F.col("base") - F.col("value")).otherwise(F.col("value") - F.col("base"))
    return metrics.join(baseline, "name", "left").withColumn("passed", F.col("base").isNull() | (worse <= slack))


def newest(rows: DataFrame, when: str, keep: int, tie: str) -> DataFrame:
    """The `keep` newest entries: those no older than the oldest of the newest, a top-k and a semi join."""
    return rows.orderBy(F.desc(when), tie).limit(keep)


def against_earlier(now: DataFrame, before: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of a run with their change from an earlier one; keys that only one of them has keep no change."""
    old = before.select(*keys, *(F.col(m).alias(f"_{m}") for m in metrics))
    joined = now.join(old, keys, "left")
    return joined.withColumns({f"d_{m}": F.bround(F.col(m) - F.col(f"_{m}"), 4) for m in metrics}).drop(*(f"_{m}" for m in metrics))
