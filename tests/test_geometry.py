import random

from pyspark.sql import functions as F

from verso.operators import geometry
from verso.sources import sinks


def test_round_trip_and_corners(spark):
    rng = random.Random(2)
    quads = [[rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(900, 990), rng.uniform(0, 60), rng.uniform(850, 999), rng.uniform(1200, 1300), rng.uniform(0, 50), rng.uniform(1100, 1300)] for _ in range(40)]
    df = spark.createDataFrame([(q,) for q in quads], "q array<double>").withColumn("m", geometry.sheet_to_page("q", F.lit(850.0), F.lit(1180.0)))
    corners = [geometry.project(F.col("m"), F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (850.0, 0.0), (850.0, 1180.0), (0.0, 1180.0))]
    there = geometry.project(F.col("m"), F.lit(321.5), F.lit(77.25))
    back = geometry.project(geometry.inverse(F.col("m")), *there)
    for r in df.select("q", F.array(*(v for c in corners for v in c)).alias("c"), F.array(*back).alias("b")).collect():
        assert max(abs(a - b) for a, b in zip(r["q"], r["c"], strict=True)) < 1e-6
        assert abs(r["b"][0] - 321.5) < 1e-6 and abs(r["b"][1] - 77.25) < 1e-6


def test_degenerate_pages(spark):
    flat = [0.0, 0.0, 5.0, 0.0, 9.0, 0.0, 3.0, 0.0]
    rows = spark.createDataFrame([(1, flat), (2, [10.0, 20.0, 110.0, 20.0, 110.0, 220.0, 10.0, 220.0]), (3, None)], "page long, q array<double>")
    matrices = rows.select("page", geometry.sheet_to_page("q", F.lit(100.0), F.lit(200.0)).alias("matrix"))
    boxes = spark.createDataFrame([(p, 1.0, 2.0, 3.0, 5.0) for p in (1, 2, 3, 4)], "page long, x0 double, y0 double, x1 double, y1 double")
    got = {r["page"]: tuple(r)[1:] for r in geometry.mapped(boxes, matrices, "page", digits=6).collect()}
    assert got == {1: (1, 2, 3, 5), 2: (11, 22, 13, 25), 3: (1, 2, 3, 5), 4: (1, 2, 3, 5)}
    assert spark.range(1).select(geometry.inverse(F.array(*(F.lit(0.0) for _ in range(9)))).alias("m")).first()["m"] is None


def test_a_dictionary_in_buckets_does_not_move(spark, tmp_path):
    words = spark.range(2000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), F.lit(True).alias("known"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sinks.write_lexicon(words, "some_lexicon", str(tmp_path / "lexicon"), "word", buckets=8)
        asked = spark.range(50, 60).select(F.concat(F.lit("w"), (F.col("id") * 100).cast("string")).alias("word"))
        joined = asked.join(spark.table("some_lexicon"), "word", "left")
        assert joined.filter("known").count() == 0 and asked.count() == 10
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS some_lexicon")
