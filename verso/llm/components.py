"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.llm.common import remove, staged_at


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node that it reaches.

    A step sends each neighbour to the smallest node around; stars replace chains, so the number of
    steps grows with the logarithm of the longest path. Every step's edges are a written table, of which
    the last stays.
    """
    spark = edges.sparkSession
    table, path = staged_at(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges-0"
    )
    before = None
    for step in count(1):
        # Large star: larger neighbours of each node are tied to the smallest node around it.
        both = table.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(table.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("least"))
        tied = both.join(least, "n").select("m", F.least("n", "least").alias("root")).filter("m > root").distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        root = tied.groupBy("m").agg(F.min("root").alias("least"))
        small = (
            tied.join(root, "m")
            .select(F.col("root").alias("hi"), F.col("least").alias("lo"))
            .filter("hi > lo")
            .union(root.select(F.col("m").alias("hi"), F.col("least").alias("lo")))
            .distinct()
        )
        done = path
        table, path = staged_at(small, f"edges-{step}")
        remove(spark, done)
        now = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return table.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = now
