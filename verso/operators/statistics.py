"""Order statistics, weighted means and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verso.operators.scoring import ratio
from verso.session import written


def rank_values(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Order statistics of large groups: values are counted first, so that no group is gathered.

    Per key and distinct value a running count says which ranks the value holds.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys).orderBy(value)
    upto = F.sum("_c").over(order)
    total = F.sum("_c").over(Window.partitionBy(*keys))
    ranked = counts.withColumns({"_upto": upto, "_n": total})
    pick = {}
    for name, p in points.items():
        at = F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n")))
        pick[name] = F.min(F.when(F.col("_upto") > at, F.col(value))).alias(name)
    mean = F.sum(F.col(value) * F.col("_c")) / F.sum("_c")
    return ranked.groupBy(*keys).agg(F.sum("_c").alias("n"), F.bround(mean, 3).alias("mean"), *pick.values())


def text_mass(text: Column, conf: Column) -> Column:
    return F.sum(conf * F.length(text))


def weighted_confidence(text: Column, conf: Column) -> Column:
    """Mean confidence by text length."""
    return text_mass(text, conf) / F.nullif(F.sum(F.length(text)), F.lit(0))


def page_floor(median: Column) -> Column:
    """Confidence below which a word of the page is weak."""
    return F.least(F.lit(70.0), F.greatest(F.lit(35.0), median - 20))


#: Constants of the linear congruential draws.
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 2147483648


#: A draw is one of so many numbers before it is folded to the units of its key, so later units are never drawn.
REACH = MODULUS // 65536
#: Draws that are made from one row, and units within reach up to which their table is broadcast (some 40 MB).
DRAWS, FEW_UNITS = 1_048_576, 1_000_000


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add _i, the place (from 0) of each row among those of its key by `order`.

    Rows are range partitioned, counted per partition and numbered inside it, so that no key is one task.
    The partitions are a written table, as their sampled bounds must be the same for both uses.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select(*keys, "_part", (F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_c")).alias("_before"))
    inside = ranged.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)))
    return inside.join(before, [*keys, "_part"]).withColumn("_i", F.col("_before") + F.col("_place") - 1).drop("_part", "_before", "_place")


def drawn_counts(iteration: int, first: int, stop: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Units that the slots from `first` to `stop` of an iteration draw, and how often: two steps of a linear congruential generator a slot."""
    x = np.arange(first, stop, dtype=np.int64) * 1009 + (iteration * 100003 + seed)
    for _ in range(2):
        x = (x * MULTIPLIER + INCREMENT) % MODULUS  # whole numbers wrap at a multiple of the modulus
    found = np.bincount(x // 65536 % n)
    at = np.flatnonzero(found)
    return at, found[at]


def _counted(seed: int):
    """Blocks of draws to (keys, _iter, _i, _c): how often each unit is drawn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, places, counts, held = [], [], [], 0
            for row, (iteration, first, n) in enumerate(zip(pdf["_iter"], pdf["_first"], pdf["_n"], strict=True)):
                at, found = drawn_counts(int(iteration), int(first), int(min(n, first + DRAWS)), int(n), seed)
                rows.append(np.full(len(at), row))
                places.append(at)
                counts.append(found)
                held += len(at)
                if held >= DRAWS or row == len(pdf) - 1:
                    out = pdf.drop(columns=["_first", "_n"]).iloc[np.concatenate(rows)]
                    yield out.assign(_i=np.concatenate(places), _c=np.concatenate(counts))
                    rows, places, counts, held = [], [], [], 0

    return run


def bootstrap(units: DataFrame, keys: list[str], iterations: int = 2000, seed: int = 17, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of sum(top) / sum(bottom) under resampling of the units of each key.

    `units` has the keys, unit (in whose order they are numbered), top and bottom, one row per unit (a
    document, or a cluster of them). Groups with one unit have no interval. Work is units x iterations,
    dealt in blocks of draws; draws are counted in their block by unit before they meet the units, and only
    the first `REACH` units of a key can be drawn, so what moves is keys x iterations x `REACH` rows at most.
    """
    sizes = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("top").alias("_t"), F.sum("bottom").alias("_b"))
    total = sizes.agg(F.sum(F.least("_n", F.lit(REACH)))).first()[0] or 0
    own = numbered(units, keys, "unit").filter(F.col("_i") < REACH).select(*keys, "_i", "top", "bottom")
    blocks = sizes.select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_iter"))
    blocks = blocks.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(DRAWS).cast("long"))))
    # Blocks cost time rather than bytes, so they are dealt by number and not put together by size.
    blocks = blocks.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_iter", "_first")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*keys, "_iter").schema.fields)
    drawn = blocks.mapInPandas(_counted(seed), f"{schema}, _i long, _c long")
    drawn = drawn.join(F.broadcast(own) if total <= FEW_UNITS else own, [*keys, "_i"])
    values = drawn.groupBy(*keys, "_iter").agg((F.sum(F.col("_c") * F.col("top")) / F.nullif(F.sum(F.col("_c") * F.col("bottom")), F.lit(0))).alias("_v"))
    ends = values.filter("_v is not null").groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_vs"))
    m = F.size("_vs")
    lo = F.try_element_at("_vs", (F.floor(F.lit(alpha / 2) * m) + 1).cast("int"))
    hi = F.try_element_at("_vs", F.least(m, F.floor(F.lit(1 - alpha / 2) * m) + 1).cast("int"))
    out = sizes.join(ends, keys, "left")
    several = F.col("_n") > 1
    return out.select(
        *keys,
        F.col("_n").alias("n_units"),
        ratio(F.col("_t"), F.col("_b")).alias("point"),
        F.when(several, F.bround(lo, 4)).alias("lo"),
        F.when(several, F.bround(hi, 4)).alias("hi"),
    )
