"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.session import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that an edge joins to another; component is the least node it reaches.

    Nodes are of any type that can be ordered, structs included; loops, repeated edges and both directions of
    one count once, and edges with a null end are left out. Each node points at a smaller one. A round first
    ties every larger neighbour of a node to the least node around it, then each node to the least it is tied to, so
    chains fold up and the rounds grow with the logarithm of the longest path. A round is a written table.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    links = written(ends.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct(), "links")
    state = None
    while True:
        around = links.union(links.select("to", "node")).groupBy("node").agg(F.min("to").alias("low"))
        both = links.union(links.select("to", "node"))
        wide = both.join(around, "node").select(F.col("to").alias("node"), F.least("node", "low").alias("to")).filter("node > to").distinct()
        least = wide.groupBy("node").agg(F.min("to").alias("low"))
        rest = wide.join(least, "node").filter("to > low").select(F.col("to").alias("node"), F.col("low").alias("to"))
        links = written(rest.union(least.select("node", "low")).distinct(), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first())
        if now == state:
            return links.select("node", F.col("to").alias("component"))
        state = now
