"""Distances and common blocks of long texts against the plain ways, which cost a step for every cell of a table."""

import random

import pytest
from pyspark.sql import functions as F

from verso.functions import distance
from verso.operators import layout


def pairs(alphabet, most, n=40):
    rng = random.Random(5)
    for _ in range(n):
        a = "".join(rng.choices(alphabet, k=rng.randint(0, most)))
        b = "".join(rng.choices(alphabet, k=rng.randint(0, most)))
        yield a, (a[: len(a) // 2] + b[len(b) // 3 :] if rng.random() < 0.5 else b)


@pytest.mark.parametrize("alphabet", ["ab", "abcdé😀 xyz"])
def test_edits_as_levenshtein(spark, alphabet):
    rows = [*pairs(alphabet, 400), ("a" * 500, None), (None, "b"), ("a" * 300, "a" * 299 + "b"), ("", "b" * 9000)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(distance.edits(F.col("a"), F.col("b")).alias("e")).collect() == df.select(F.levenshtein("a", "b").alias("e")).collect()


def test_scores_of_long_pairs_leave_the_cell_table(spark):
    from verso.plans.catalogue import QUERIES

    for name in ("k1_cer_pairs", "headline_by_lang", "a7_headline_by_source", "a7_headline_intervals", "a23_field_cer", "s1_worst15"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "_long_edits" in plan, name


def test_common_block_is_the_first_longest(monkeypatch):
    for held in (distance.HELD, 200):  # the second one makes long blocks go place by place
        monkeypatch.setattr(distance, "HELD", held)
        for a, b in [*pairs("ab", 90), *pairs("abcdefgh xyz", 150), ("xabcy", "abc"), ("abc", "zabcabc")]:
            x, y = distance._codes(a), distance._codes(b)
            want = distance.longest_block(x, y, y == y) if a and b else (0, 0, 0)
            found = distance.common_block(a, b)
            assert found[2] == want[2] and (not want[2] or found == want), (a, b)


def test_pieces_that_share_a_block(spark):
    rows = [*pairs("ab", 12), *pairs("abcdefgh", 30), ("", ""), ("", "a"), ("abcde", "xabcx"), ("abcde", "xcdex"), ("abcde", "xbcdx"), ("abcde", "xabx")]
    df = spark.createDataFrame(rows, "a string, b string")
    common = F.length(distance.longest_common_substring(F.col("a"), F.col("b"))) >= F.least(F.length("a"), F.length("b")) * F.lit(0.6)
    found = df.select(layout.shares_block(F.col("a"), F.col("b"), 0.6).alias("found"), common.alias("want")).collect()
    assert [r["found"] for r in found] == [r["want"] for r in found] and len({r["want"] for r in found}) == 2
