"""What leaves the JVM, what is one task's, and how often a rule runs on a text."""

from pyspark.sql import functions as F

from verso.functions import text
from verso.operators import layout, lexicon
from verso.plans.catalogue import LATIN_GROUPS


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_end_of_a_text_is_looked_at_for_loops(spark):
    end = "abc" * 30
    df = spark.createDataFrame([("x" * 5000 + end,), (end,), ("é" * 700,), ("",), (None,)], "t string").select(layout.phrase_loop(F.col("t")).alias("n"))
    assert "right(" in plan(df) or "substring" in plan(df)
    assert [r["n"] for r in df.collect()] == [layout.loop_length(t) for t in ("x" * 5000 + end, end, "é" * 700, "", "")]


def test_words_that_stay_are_not_one_key(spark):
    words = spark.range(4000).select(F.col("id"), F.lit("word").alias("word"), F.when(F.col("id") % 10 == 0, 10.0).otherwise(99.0).alias("conf"))
    lex = spark.createDataFrame([("wórd",)], "word string")
    found = lexicon.fix_words(words, lex, LATIN_GROUPS, script="^[a-zà-ÿ]+$")
    assert "_deal" in plan(found)
    assert found.groupBy("fixed", "rule").count().sort("fixed").collect() == [("word", "kept", 3600), ("wórd", "moved", 400)]


def test_tokens_are_distinct_before_rules_run(spark):
    df = spark.createDataFrame([("سلام، سلام x سلام، يك یک",)], "t string").select(text.token_set(F.col("t")).alias("s"))
    assert df.first()["s"] == ["سلام", "یک"] and plan(df.filter(F.col("s").isNotNull())).count("array_distinct") >= 3


def test_turns_are_not_sent_to_the_driver(spark, sf):
    from verso.plans.catalogue import QUERIES

    assert "rightHint=(strategy=broadcast)" in plan(QUERIES["a26_arms"](spark, sf))
