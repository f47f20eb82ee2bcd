"""Bootstrap intervals of keys with more units than the draws reach."""

import numpy as np
from pyspark.sql import functions as F

from verso.operators import statistics


def brute(n, iterations, seed=17):
    """Sums of a top of (unit % 7 == 0) under the drawn units, slot by slot."""
    out = []
    for it in range(iterations):
        total = 0
        for slot in range(n):
            x = it * 100003 + slot * 1009 + seed
            for _ in range(2):
                x = (x * 1103515245 + 12345) % 2147483648
            total += (x // 65536 % n) % 7 == 0
        out.append(total / n)
    return sorted(out)


def test_bootstrap_beyond_reach_moves_counts(spark, monkeypatch):
    monkeypatch.setattr(statistics, "FEW_UNITS", 40_000)
    monkeypatch.setattr(statistics, "DRAWS", 10_000)
    n = {"a": 45_000, "b": 900}
    units = spark.range(n["a"] + n["b"]).select(F.when(F.col("id") < n["a"], "a").otherwise("b").alias("k"), F.when(F.col("id") < n["a"], F.col("id")).otherwise(F.col("id") - n["a"]).alias("unit"))
    units = units.withColumns({"top": (F.col("unit") % 7 == 0).cast("int"), "bottom": F.lit(1)})
    found = statistics.bootstrap(units, ["k"], iterations=6)
    # 45,900 units, of which draws reach 33,668: few enough to be sent to the draws.
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    for row in found.collect():
        values = brute(n[row["k"]], 6)
        assert (row["n_units"], row["lo"], row["hi"]) == (n[row["k"]], round(values[0], 4), round(values[5], 4))


def test_draws_of_many_slots_do_not_overflow():
    at, counts = statistics.drawn_counts(199, 10**10, 10**10 + 50, 10**11, 17)
    want = []
    for slot in range(10**10, 10**10 + 50):
        x = 199 * 100003 + slot * 1009 + 17
        for _ in range(2):
            x = (x * 1103515245 + 12345) % 2147483648
        want.append(x // 65536)
    assert sorted(np.repeat(at, counts).tolist()) == sorted(want)
