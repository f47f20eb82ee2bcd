"""Boxes and readings as streams over sorted rows: the same as the plain ways, without a call, a join or a table for every group."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from verso.operators import clusters, graph, layout
from verso.plans.catalogue import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_islands_of_readings_are_one_stream(spark, sf):
    assert "FlatMapGroupsInPandas" not in plan(QUERIES["c6_select_readings"](spark, sf))
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"page": np.sort(rng.integers(0, 6, 300)), "_island": 0, "score": rng.integers(1, 9, 300) * 1.0, "x0": rng.integers(0, 90, 300), "y0": rng.integers(0, 9, 300)})
    rows["_island"] = rng.integers(0, 9, 300)
    rows = rows.sort_values(["page", "_island"], kind="stable").assign(x1=lambda r: r.x0 + 20, y1=lambda r: r.y0 + 10)
    whole = pd.concat(layout._chosen("page")(iter([rows]))).reset_index(drop=True)
    for size in (1, 7, 64):  # batches that cut islands
        parts = [rows.iloc[at : at + size] for at in range(0, len(rows), size)]
        pd.testing.assert_frame_equal(pd.concat(layout._chosen("page")(iter(parts))).reset_index(drop=True), whole)


def test_neighbours_are_one_pass(spark):
    rng = random.Random(2)
    rows = [(p, i, x, x + rng.randint(5, 30), y, y + rng.randint(4, 20)) for p in range(5) for i in range(80) for x, y in [(rng.randint(0, 900), rng.randint(0, 40))]]
    boxes = spark.createDataFrame(rows, "page long, box long, x0 int, x1 int, y0 int, y1 int")
    found = clusters.neighbour_groups(boxes, ["page"])
    assert "Join" not in plan(found)
    node = lambda c: F.struct("page", F.col(c).alias("box"))
    joined = graph.connected_components(clusters.neighbour_links(boxes, ["page"]).select(node("a").alias("a"), node("b").alias("b"))).collect()
    want = {(p, i): i for p, i, *_ in rows} | {tuple(r["node"]): r["component"]["box"] for r in joined}
    assert {(r["page"], r["box"]): r["line"] for r in found.collect()} == want and len(set(want.values())) > 5


def test_gaps_and_bands_as_by_looking_at_all():
    rng = random.Random(3)
    for _ in range(300):
        boxes = sorted((x, x + rng.randint(1, 60)) for x in (rng.randint(0, 200) for _ in range(rng.randint(1, 12))))
        along = clusters._Along()
        for box in boxes:
            along.add(*box)
        x0 = rng.randint(0, 220)
        assert along.gap(x0, x0 + 5) == min(max(a - x0 - 5, x0 - b, 0) for a, b in boxes)
        bands = [clusters._Band(i, y, y + rng.randint(1, 30), y) for i, y in enumerate(rng.randint(0, 80) for _ in range(10))]
        y = rng.randint(0, 80)
        edges = np.array([[b.top for b in bands], [b.low for b in bands]])
        assert clusters._fitting(bands, y, y + 9) == clusters._fitting_of_many(edges, y, y + 9)
