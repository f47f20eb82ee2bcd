"""Drawn weights against their exact sums and against plain resampling."""

import numpy as np
from pyspark.sql import functions as F

from verso.operators import resampling, scoring


def test_counts_add_up_and_weights_are_multinomial():
    for n, size in ((1, 4), (7, 4), (100, 8), (1000, 64)):
        blocks = -(-n // size)
        counts = np.stack([resampling.split_counts(n, b, 500, [3, 9], size) for b in range(blocks)])
        assert (counts.sum(axis=0) == n).all()
        sizes = np.array([min(size, n - b * size) for b in range(blocks)])
        assert np.allclose(counts.mean(axis=1), sizes, atol=0.3 + 0.02 * size)
        assert np.allclose(counts.var(axis=1), sizes * (1 - sizes / n), rtol=0.35, atol=0.01)
    units = np.stack([np.ones(700), np.arange(700)], axis=1)
    sums = resampling.weighted_sums(units, np.full(4000, 700), [1, 2])
    assert (sums[:, 0] == 700).all()
    assert abs(sums[:, 1].mean() - 349.5 * 700) < 150 and abs(sums[:, 1].std() / (np.arange(700).std() * np.sqrt(700)) - 1) < 0.05
    single = resampling.weighted_sums(np.eye(5), np.full(4000, 5), [4])
    assert (single.sum(axis=1) == 5).all() and np.allclose(np.cov(single.T), np.eye(5) - 0.2, atol=0.06)


def test_intervals_agree_with_plain_resampling(spark):
    rng = np.random.default_rng(5)
    top, bottom = rng.poisson(3, 300), rng.integers(5, 20, 300)
    rows = [("a", i, int(t), int(b)) for i, (t, b) in enumerate(zip(top, bottom, strict=True))] + [(None, 1, 1, 4), ("none", 1, 0, 0), ("none", 2, 0, 0)]
    df = spark.createDataFrame(rows, "k string, unit long, top long, bottom long").repartition(3)
    out = {r["k"]: r for r in resampling.intervals(df, ["k"]).collect()}
    again = {r["k"]: r for r in resampling.intervals(df.repartition(7), ["k"]).collect()}
    assert out == again
    picks = rng.integers(0, 300, (4000, 300))
    plain = np.quantile(top[picks].sum(axis=1) / bottom[picks].sum(axis=1), [0.025, 0.975])
    assert abs(out["a"]["lo"] - plain[0]) < 0.004 and abs(out["a"]["hi"] - plain[1]) < 0.004
    assert out[None]["n_units"] == 1 and out[None]["lo"] is None and out[None]["point"] == 0.25
    assert out["none"]["point"] is None and out["none"]["hi"] is None
    assert resampling.intervals(df.limit(0), ["k"]).count() == 0


def test_no_row_per_draw(spark):
    """Whatever the number of units, what is joined or shuffled is units and sums of blocks."""
    df = spark.range(40_000).select(F.lit("k").alias("k"), F.col("id").alias("unit"), (F.col("id") % 2).alias("top"), F.lit(1).alias("bottom"))
    r = resampling.intervals(df, ["k"]).first()
    assert r["n_units"] == 40_000 and r["point"] == 0.5 and 0.4935 < r["lo"] < 0.4965 and 0.5035 < r["hi"] < 0.5065


def test_headline_intervals(spark):
    fields = "doc long, lang string, source string, usable boolean, field string, has_gt boolean, gt string, pred string"
    rows = [(d, "x", f"s{d % 4}", d % 5 > 0, f"f{f}", True, "abcdefghij", "abcdefghij" if (d % 4 + f) % 3 else "abcdefghxx") for d in range(60) for f in range(4)]
    out = {r["statistic"]: r for r in resampling.headline_intervals(scoring.outcomes(spark.createDataFrame(rows, fields)), ["lang"], "source").collect()}
    assert out["usable_rate"]["point"] == 0.8 and out["usable_rate"]["n_by_document"] == 60 and out["usable_rate"]["n_by_cluster"] == 4
    head = scoring.headline(scoring.outcomes(spark.createDataFrame([r for r in rows if r[3]], fields)), "lang").first()
    assert out["cer_given_output"]["point"] == head["cer_given_output"] and out["cer_given_output"]["n_by_document"] == 48
    for r in out.values():
        assert r["lo_by_document"] <= r["point"] <= r["hi_by_document"] and r["lo_by_cluster"] <= r["point"] <= r["hi_by_cluster"]
