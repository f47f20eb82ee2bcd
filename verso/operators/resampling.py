"""Bootstrap intervals from drawn weights: a resample is a count per unit, so no draw becomes a row.

The units of a group are numbered and stand in blocks of equal size. How many of a resample's n draws fall into a
block follows from splitting n in two, again and again, by binomial draws whose generator is seeded with the range of
blocks that is split: every block finds its own count on its own, and all of them add up to n. Inside a block the
count is dealt over its units and multiplied with their values. A block hands on two sums per iteration.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.operators.scoring import ratio
from verso.operators.statistics import numbered

#: Units of a block, and of a piece of one whose weights are held at once (iterations x units).
BLOCK, PIECE = 8192, 256


def split_counts(n: int, block: int, iterations: int, seed: list[int], size: int = BLOCK) -> np.ndarray:
    """Of n draws over n units, those that fall into a block of `size` units, for each iteration."""
    low, high, drawn = 0, -(-n // size), np.full(iterations, n, dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * size / (min(high * size, n) - low * size)
        left = np.random.default_rng([*seed, low, high]).binomial(drawn, share)
        if block < middle:
            high, drawn = middle, left
        else:
            low, drawn = middle, drawn - left
    return drawn


def weighted_sums(values: np.ndarray, drawn: np.ndarray, seed: list[int]) -> np.ndarray:
    """Sums of the columns of `values` (units x measures) under `drawn` draws of its rows, one row per iteration."""
    rng, left = np.random.default_rng(seed), drawn.copy()
    out = np.zeros((len(drawn), values.shape[1]))
    for at in range(0, len(values), PIECE):
        piece = values[at : at + PIECE]
        here = rng.binomial(left, len(piece) / (len(values) - at)) if at + PIECE < len(values) else left
        out += rng.multinomial(here, np.full(len(piece), 1 / len(piece))) @ piece
        left = left - here
    return out


def _block_sums(iterations: int, seed: int):
    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n, block = pdf["_key"].iloc[0], int(pdf["_n"].iloc[0]), int(pdf["_block"].iloc[0])
        own = [seed, zlib.crc32(key.encode())]
        values = pdf.sort_values("_i")[["top", "bottom"]].to_numpy(float)
        found = weighted_sums(values, split_counts(n, block, iterations, own), [*own, block])
        return pd.DataFrame({"_key": key, "_iter": np.arange(iterations, dtype=np.int32), "_t": found[:, 0], "_b": found[:, 1]})

    return sums


def intervals(units: DataFrame, keys: list[str], iterations: int = 2000, seed: int = 17, alpha: float = 0.05) -> DataFrame:
    """(keys, n_units, point, lo, hi): percentile interval of sum(top) / sum(bottom) over resampled units.

    `units` has the keys (nulls are a group), unit (in whose order units are numbered), top and bottom. Results are the same
    on every run. A group of one unit, or without a resample whose bottom is not zero, has no interval. Work is units x
    iterations in numpy; what is shuffled is the units once and two sums per block of units and iteration, added up
    before they move.
    """
    named = units.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key"), *keys, "unit", "top", "bottom")
    sizes = named.groupBy("_key").agg(
        *(F.first(k).alias(k) for k in keys), F.count(F.lit(1)).alias("_n"), F.sum("top").alias("_top"), F.sum("bottom").alias("_bottom")
    )
    own = numbered(named.select("_key", "unit", "top", "bottom"), ["_key"], "unit")
    blocks = own.join(sizes.select("_key", "_n"), "_key").withColumn("_block", F.floor(F.col("_i") / BLOCK))
    rows = blocks.select("_key", "_n", "_block", "_i", F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"))
    # Blocks cost time rather than bytes, so they are dealt by number and not put together by size.
    rows = rows.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key", "_block")
    sums = rows.groupBy("_key", "_block").applyInPandas(_block_sums(iterations, seed), "_key string, _iter int, _t double, _b double")
    values = sums.groupBy("_key", "_iter").agg((F.sum("_t") / F.nullif(F.sum("_b"), F.lit(0.0))).alias("_v"))
    ends = values.filter("_v is not null").groupBy("_key").agg(F.array_sort(F.collect_list("_v")).alias("_vs"))
    m, several = F.size("_vs"), F.col("_n") > 1
    lo = F.get("_vs", F.floor(F.lit(alpha / 2) * m).cast("int"))
    hi = F.get("_vs", F.least(m - 1, F.floor(F.lit(1 - alpha / 2) * m)).cast("int"))
    return sizes.join(ends, "_key", "left").select(
        *keys,
        F.col("_n").alias("n_units"),
        ratio(F.col("_top"), F.col("_bottom")).alias("point"),
        F.when(several, F.bround(lo, 4)).alias("lo"),
        F.when(several, F.bround(hi, 4)).alias("hi"),
    )


def headline_intervals(rows: DataFrame, keys: list[str], cluster: str, iterations: int = 2000, seed: int = 17) -> DataFrame:
    """(keys, statistic, point, and n, lo, hi by document and by cluster) of the headline figures.

    `rows` are scored fields with doc, usable and the cluster that a document comes from. Documents of one cluster are
    alike, so an interval over documents is too narrow; both stand side by side. The error given output is over
    documents with usable output. Both kinds of units and all statistics are resampled in one pass.
    """
    scored, charged = F.col("outcome") == "scored", F.col("outcome").isin("scored", "omission")
    docs = rows.groupBy(*keys, cluster, "doc").agg(
        F.max("usable").alias("usable"),
        F.sum(F.when(scored, F.col("edits"))).alias("edits"),
        F.sum(F.when(scored, F.col("gt_len"))).alias("length"),
        F.sum(F.when(charged, F.when(F.col("usable") & scored, F.col("edits")).otherwise(F.col("gt_len")))).alias("cost"),
        F.sum(F.when(charged, F.col("gt_len"))).alias("whole"),
    )
    usable = F.col("usable")
    stat = lambda name, top, bottom: F.struct(F.lit(name).alias("statistic"), top.cast("double").alias("top"), bottom.cast("double").alias("bottom"))
    given = F.when(usable, stat("cer_given_output", F.col("edits"), F.col("length")))
    stats = F.array(stat("usable_rate", F.when(usable, 1).otherwise(0), F.lit(1)), given, stat("effective_cer", F.col("cost"), F.col("whole")))
    kind = lambda name, unit: F.struct(F.lit(name).alias("kind"), F.col(unit).cast("string").alias("unit"))
    spread = docs.select(*keys, F.array(kind("document", "doc"), kind("cluster", cluster)).alias("_ks"), F.explode(F.array_compact(stats)).alias("_s"))
    spread = spread.select(*keys, F.explode("_ks").alias("_k"), "_s")
    units = spread.groupBy(*keys, F.col("_s.statistic").alias("statistic"), F.col("_k.kind").alias("kind"), F.col("_k.unit").alias("unit")).agg(
        F.coalesce(F.sum("_s.top"), F.lit(0.0)).alias("top"), F.coalesce(F.sum("_s.bottom"), F.lit(0.0)).alias("bottom")
    )
    found = intervals(units, [*keys, "statistic", "kind"], iterations, seed)
    pick = lambda name, c: F.max(F.when(F.col("kind") == name, F.col(c)))
    return found.groupBy(*keys, "statistic").agg(
        F.max("point").alias("point"),
        *(pick(k, c).alias(f"{n}_by_{k}") for k in ("document", "cluster") for c, n in (("n_units", "n"), ("lo", "lo"), ("hi", "hi"))),
    )
