"""Graph components and box clusters against brute force."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from verso.operators import clusters, graph

BOXES = "page long, box long, x0 int, y0 int, x1 int, y1 int"


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components(spark, kind):
    rng = random.Random(4)
    n = 300
    links = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(200)], "chain": [(i, i + 1) for i in range(n)], "star": [(7, i) for i in range(n)] * 2}[kind]
    got = graph.connected_components(spark.createDataFrame([*links, (5, 5), (None, 3), (4, None)], "a long, b long"))
    want = roots(links, range(n + 1))
    joined = {x for a, b in links for x in (a, b) if a != b and want[x] != x}
    assert {(r["node"], r["component"]) for r in got.collect()} == {(x, want[x]) for x in joined}
    structs = spark.createDataFrame(links, "a long, b long").select(*(F.struct(F.lit("p").alias("p"), F.col(c).alias("n")).alias(c) for c in "ab"))
    if kind == "random":
        assert graph.connected_components(structs).count() == len(joined)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def page(seed, n):
    """Drifting rows of boxes of uneven heights, specks, dots and blobs; ties of every kind."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        row, x = rng.randrange(6), rng.randrange(0, 900, 15)
        h = rng.choice([3, 7, 18, 30, 30, 34, 40, 40, 95])
        y = row * rng.choice([45, 50, 60]) + x // 25 + rng.randrange(0, 9, 3)
        out.append((i, x, y, x + rng.choice([4, 20, 20, 70]), y + h))
    return out


def clustered(boxes):
    """{box: line} by the rules, one box after the other."""
    hs = [b[4] - b[2] for b in boxes]
    ref = median([h for h in hs if h >= median(hs)])
    seed = max(6.0, 0.62 * ref)
    tall = [b for b in boxes if b[4] - b[2] >= seed] or boxes
    small = [b for b in boxes if b not in tall]
    lines = []
    for b in sorted(tall, key=lambda b: ((b[2] + b[4]) / 2, b[0])):
        h = b[4] - b[2]
        choice = None
        for line in lines[::-1]:
            if line["low"] < b[2] - 4 * h and line["top"] < b[2] - 6 * h:
                break
            share = min(b[4], line["low"]) - max(b[2], line["top"])
            if share > 0 and share >= 0.5 * min(h, line["low"] - line["top"]) and (choice is None or share > choice[0]):
                choice = (share, line)
        if choice is None:
            lines.append({"name": b[0], "top": b[2], "low": b[4], "hs": [h], "boxes": [b]})
            continue
        line = choice[1]
        line["boxes"].append(b)
        line["hs"].append(h)
        if len(line["hs"]) < 6 or h <= 2 * median(line["hs"]):
            line["top"], line["low"] = min(line["top"], b[2]), max(line["low"], b[4])
    out = {}
    for b in sorted(small, key=lambda b: (b[1], b[0])):
        mid = (b[2] + b[4]) / 2
        near = [ln for ln in lines if ln["top"] - 0.35 * (ln["low"] - ln["top"]) <= mid <= ln["low"] + 0.35 * (ln["low"] - ln["top"])]
        out[b[0]] = None
        if near:
            gap = lambda ln: min(max(m[1] - b[3], b[1] - m[3], 0) for m in ln["boxes"])  # noqa: B023, E731
            min(near, key=lambda ln: (gap(ln), abs(mid - (ln["top"] + ln["low"]) / 2)))["boxes"].append(b)  # noqa: B023
    for ln in lines:
        names = dict.fromkeys((b[0] for b in ln["boxes"]), ln["name"])
        if ln["low"] - ln["top"] > 1.7 * median(ln["hs"]) and len(ln["boxes"]) >= 6:
            row, links = sorted(ln["boxes"], key=lambda b: (b[1], b[0])), []
            for i, a in enumerate(row):
                for b in row[i + 1 : i + 25]:
                    ha, hb = a[4] - a[2], b[4] - b[2]
                    if b[1] - a[3] > 1.5 * max(ha, hb):
                        break
                    if min(a[4], b[4]) - max(a[2], b[2]) >= 0.4 * min(ha, hb):
                        links.append((a[0], b[0]))
            names = roots(links, names)
        out.update(names)
    return out


def test_text_lines_equal_brute_force(spark):
    pages = {p: page(p, n) for p, n in enumerate([1, 2, 5, 40, 40, 80, 120, 200, 200])}
    pages[20] = [(i, i * 9, i % 3, i * 9 + 2, i % 3 + 3) for i in range(7)]  # small marks alone
    pages[21] = [(0, 0, 0, 20, 40), (1, 30, 0, 50, 40), (2, 10, 900, 12, 903)]  # a stray mark
    df = spark.createDataFrame([(p, *b) for p, bs in pages.items() for b in bs], BOXES).repartition(3)
    got = {(r["page"], r["box"]): r["line"] for r in clusters.text_lines(df).collect()}
    want = {(p, box): line for p, bs in pages.items() for box, line in clustered(bs).items()}
    assert got == want
    assert None in want.values() and len(set(want.values())) > 20
    assert clusters.text_lines(df.limit(0)).count() == 0


def test_absorbed_and_numbers(spark):
    pages = {p: page(p, n) for p, n in enumerate([1, 30, 90])}
    df = spark.createDataFrame([(p, *b) for p, bs in pages.items() for b in bs], BOXES).repartition(3)
    got = {(r["page"], r["box"]): r["whole"] for r in clusters.absorbed(df, ["page"]).collect()}
    want = {}
    for p, bs in pages.items():
        grown = []
        for b in sorted(bs, key=lambda b: (-(b[3] - b[1]) * (b[4] - b[2]), b[0])):
            for g in grown:
                share, tall = min(b[3], g[3]) - max(b[1], g[1]), g[4] - g[2]
                if share > 0 and share >= 0.5 * (b[3] - b[1]) and b[4] >= g[2] - tall and b[2] <= g[4] + tall:
                    g[1:] = [min(g[1], b[1]), min(g[2], b[2]), max(g[3], b[3]), max(g[4], b[4])]
                    break
            else:
                g = list(b)
                grown.append(g)
            want[p, b[0]] = g[0]
    assert got == want and len(set(want.values())) < len(want)
    row = [(1, i, x, 0, x + 18, 20) for i, x in enumerate([0, 20, 40, 90, 110, 130, 150])] + [(1, 9, 170, 0, 230, 20), (1, 10, 232, 0, 240, 20), (1, 11, 242, 14, 246, 20), (1, 12, 250, 0, 260, 20), (1, 13, 262, 0, 270, 20)]
    found = clusters.number_places(spark.createDataFrame(row, BOXES), ["page"]).orderBy("x0").collect()
    assert [(r["x0"], r["x1"], r["n_boxes"]) for r in found] == [(0, 58, 3), (90, 168, 4), (232, 270, 4)]


def test_plans_keep_pages_out_of_one_group(spark):
    """Groups that go to Python are pieces of a page: islands of tall boxes, strips and islands of widths."""
    far = [(1, i, 0, i * 500, 20, i * 500 + 40) for i in range(30)]
    df = spark.createDataFrame(far, BOXES)
    assert clusters.islands(df, ["page"], F.col("y0"), F.col("y1"), ["box"], "n").agg(F.max("n")).first()[0] == 30
