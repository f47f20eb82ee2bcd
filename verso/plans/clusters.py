"""Registered queries on loose boxes: lines of drifting boxes and small marks, neighbours, numbers, parts of glyphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.operators import clusters, geometry
from verso.plans.catalogue import BOXES, boxes, query

#: The words' boxes with a number on their page, uneven heights, lines that drift down, and small marks.
GLYPHS = f"""{BOXES}, glyphs AS (SELECT page, line, line * 10000 + pos AS box, x0, x1, y0 + pos // 2 + (pos * 7) % 13 + CASE WHEN pos % 5 = 3 THEN 28 ELSE 0 END AS y0,
  y0 + pos // 2 + (pos * 7) % 13 + CASE WHEN pos % 5 = 3 THEN 36 ELSE 40 - (length(text) * 5) % 17 END AS y1 FROM boxes)"""


def glyphs(spark, sf_dir) -> DataFrame:
    pos, n = F.col("pos"), F.length("text")
    top = F.col("y0") + F.floor(pos / 2) + (pos * 7) % 13
    mark = pos % 5 == 3
    return boxes(spark, sf_dir).select(
        "page",
        F.col("line").cast("long").alias("line"),
        (F.col("line") * 10000 + pos).cast("long").alias("box"),
        "x0",
        "x1",
        (top + F.when(mark, 28).otherwise(0)).cast("int").alias("y0"),
        (top + F.when(mark, 36).otherwise(40 - (n * 5) % 17)).cast("int").alias("y1"),
    )


TALL = f"""{GLYPHS}, half AS (SELECT page, median(y1 - y0) AS m FROM glyphs GROUP BY page), sizes AS (SELECT page, greatest(6.0, 0.62 * median(y1 - y0)) AS seed FROM glyphs JOIN half USING (page) WHERE y1 - y0 >= m GROUP BY page),
  most AS (SELECT page, max(y1 - y0) AS most FROM glyphs GROUP BY page),
  tall AS (SELECT page, box, y0, y1, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2.0, box) AS n FROM glyphs JOIN sizes USING (page) JOIN most USING (page) WHERE y1 - y0 >= seed OR most < seed)"""


@query(
    f"""WITH RECURSIVE {TALL},
    grown AS (
      SELECT page, n, [{{'box': box, 'top': y0, 'low': y1, 'hs': [y1 - y0]}}] AS bands FROM tall WHERE n = 1
      UNION ALL
      SELECT page, n, CASE WHEN k IS NULL THEN list_append(bands, {{'box': box, 'top': y0, 'low': y1, 'hs': [y1 - y0]}})
        ELSE list_transform(bands, lambda b, i: CASE WHEN i <> k THEN b
          WHEN len(b.hs) + 1 < 6 OR y1 - y0 <= 2 * list_aggregate(list_append(b.hs, y1 - y0), 'median') THEN {{'box': b.box, 'top': least(b.top, y0), 'low': greatest(b.low, y1), 'hs': list_append(b.hs, y1 - y0)}}
          ELSE {{'box': b.box, 'top': b.top, 'low': b.low, 'hs': list_append(b.hs, y1 - y0)}} END) END
      FROM (SELECT g.page, t.n, t.box, t.y0, t.y1, g.bands,
        list_max(list_transform(list_filter(range(1, len(bands) + 1), lambda i: i > coalesce(list_max(list_filter(range(1, len(bands) + 1), lambda j: bands[j].low < t.y0 - 4 * (t.y1 - t.y0) AND bands[j].top < t.y0 - 6 * (t.y1 - t.y0))), 0)
          AND least(bands[i].low, t.y1) - greatest(bands[i].top, t.y0) > 0
          AND least(bands[i].low, t.y1) - greatest(bands[i].top, t.y0) >= 0.5 * least(bands[i].low - bands[i].top, t.y1 - t.y0)),
          lambda i: {{'ov': least(bands[i].low, t.y1) - greatest(bands[i].top, t.y0), 'k': i}})).k AS k
        FROM grown g JOIN tall t ON t.page = g.page AND t.n = g.n + 1)),
    last AS (SELECT page, unnest(bands) AS b FROM grown JOIN (SELECT page, max(n) AS n FROM tall GROUP BY page) USING (page, n))
    SELECT page, b.box AS band, len(b.hs) AS n_tall, b.top::DOUBLE AS top, b.low::DOUBLE AS low, list_aggregate(b.hs, 'median')::DOUBLE AS text_h FROM last"""
)
def c11_bands(spark, sf_dir):
    """Lines that tall boxes make, grown in order; SQL grows them box by box."""
    rows = clusters.line_bands(glyphs(spark, sf_dir), "page")
    return rows.groupBy("page", "band").agg(F.count(F.lit(1)).alias("n_tall"), *(F.first(c).alias(c) for c in ("top", "low", "text_h")))


@query()
def c11_lines(spark, sf_dir):
    """Whole line clustering with small marks and swollen bands taken apart; brute force in the tests."""
    return clusters.text_lines(glyphs(spark, sf_dir)).select("page", "box", "line")


@query(
    f"""WITH RECURSIVE {GLYPHS}, in_line AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY x0, box) AS n FROM glyphs),
    pairs AS (SELECT a.page, a.line, a.box AS a, b.box AS b, a.n AS an, b.n AS bn, b.x0 - a.x1 > 1.5 * greatest(a.y1 - a.y0, b.y1 - b.y0) AS far,
        least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.4 * least(a.y1 - a.y0, b.y1 - b.y0) AS common
      FROM in_line a JOIN in_line b ON a.page = b.page AND a.line = b.line AND b.n > a.n AND b.n <= a.n + 24),
    near AS (SELECT *, bool_or(far) OVER (PARTITION BY page, line, an ORDER BY bn) AS cut FROM pairs),
    links AS (SELECT page, line, a, b FROM near WHERE common AND NOT cut UNION SELECT page, line, b, a FROM near WHERE common AND NOT cut),
    reached AS (SELECT page, line, box AS a, box AS b FROM glyphs UNION SELECT r.page, r.line, r.a, l.b FROM reached r JOIN links l ON l.page = r.page AND l.line = r.line AND l.a = r.b)
    SELECT page, line, a AS box, min(b) AS piece FROM reached GROUP BY page, line, a"""
)
def c11_neighbours(spark, sf_dir):
    """Lines taken apart into groups of neighbours: connected components of local links."""
    keyed = glyphs(spark, sf_dir).withColumnRenamed("line", "row")
    return clusters.neighbour_groups(keyed, ["page", "row"]).select("page", F.col("row").alias("line"), "box", F.col("line").alias("piece"))


@query(
    f"""WITH {GLYPHS}, ranked AS (SELECT *, y1 - y0 AS h, row_number() OVER (PARTITION BY page, line ORDER BY y1 - y0, box) AS r, count(*) OVER (PARTITION BY page, line) AS n FROM glyphs),
    heights AS (SELECT page, line, h AS ref FROM ranked WHERE r = floor(n * 0.8) + 1 AND h >= 8),
    marked AS (SELECT *, x1 - x0 <= 1.15 * ref AND y1 - y0 <= 1.4 * ref AS narrow FROM glyphs JOIN heights USING (page, line)),
    runs AS (SELECT *, sum(CASE WHEN narrow AND x0 - before <= 0.9 * ref THEN 0 ELSE 1 END) OVER w AS run FROM (SELECT *, lag(x1) OVER (PARTITION BY page, line ORDER BY x0, box) AS before FROM marked) WINDOW w AS (PARTITION BY page, line ORDER BY x0, box))
    SELECT page, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_boxes FROM runs WHERE narrow GROUP BY page, line, run HAVING count(*) FILTER (y1 - y0 >= 0.5 * ref) >= 3"""
)
def c13_number_places(spark, sf_dir):
    return clusters.number_places(glyphs(spark, sf_dir), ["page", "line"])


#: Parts that lie under every third box, some shifted over its edge, and some far below.
PARTS = f"""{GLYPHS}, parts AS (SELECT page, line, box, x0, y0, x1, y1 FROM glyphs UNION ALL
  SELECT page, line, box + 5000, x0 + box % 7 * 4, y1 + box % 4 * 25, x0 + box % 7 * 4 + 11 + box % 5, y1 + box % 4 * 25 + 9 FROM glyphs WHERE box % 3 = 0)"""


@query(
    f"""WITH RECURSIVE {PARTS}, by_area AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY (x1 - x0) * (y1 - y0) DESC, box) AS n FROM parts),
    grown AS (
      SELECT page, line, n, [{{'box': box, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS bs, box, box AS whole FROM by_area WHERE n = 1
      UNION ALL
      SELECT page, line, n, CASE WHEN k IS NULL THEN list_append(bs, {{'box': box, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}})
        ELSE list_transform(bs, lambda m, i: CASE WHEN i <> k THEN m ELSE {{'box': m.box, 'x0': least(m.x0, x0), 'y0': least(m.y0, y0), 'x1': greatest(m.x1, x1), 'y1': greatest(m.y1, y1)}} END) END,
        box, CASE WHEN k IS NULL THEN box ELSE bs[k].box END
      FROM (SELECT p.*, g.bs, list_min(list_filter(range(1, len(bs) + 1), lambda i: least(p.x1, bs[i].x1) - greatest(p.x0, bs[i].x0) > 0 AND least(p.x1, bs[i].x1) - greatest(p.x0, bs[i].x0) >= 0.5 * (p.x1 - p.x0)
          AND p.y1 >= bs[i].y0 - (bs[i].y1 - bs[i].y0) AND p.y0 <= bs[i].y1 + (bs[i].y1 - bs[i].y0))) AS k
        FROM grown g JOIN by_area p ON p.page = g.page AND p.line = g.line AND p.n = g.n + 1))
    SELECT page, line, box, whole FROM grown"""
)
def c13_absorbed(spark, sf_dir):
    g = glyphs(spark, sf_dir)
    left = F.col("x0") + F.col("box") % 7 * 4
    top = F.col("y1") + F.col("box") % 4 * 25
    parts = g.filter("box % 3 = 0").select(
        "page", "line", (F.col("box") + 5000).alias("box"), left.cast("int").alias("x0"), (left + 11 + F.col("box") % 5).cast("int").alias("x1"), top.cast("int").alias("y0"), (top + 9).cast("int").alias("y1")
    )
    return clusters.absorbed(g.unionByName(parts), ["page", "line"]).select("page", "line", "box", "whole")


#: Corners of every page but each third, on the original, as the page's number moves them.
QUAD = ("10 + page % 7", "20 + page % 5", "900 + page % 11", "31", "880", "1200 + page % 13", "5", "1190 - page % 3")


@query(
    f"""WITH {BOXES}, q AS (SELECT page, {", ".join(f"({v})::DOUBLE AS {n}" for n, v in zip(("a1", "a2", "b1", "b2", "c1", "c2", "d1", "d2"), QUAD, strict=True))} FROM (SELECT DISTINCT page FROM boxes) WHERE page % 3 <> 0),
    p AS (SELECT *, ((a1 - b1 + c1 - d1) * (d2 - c2) - (d1 - c1) * (a2 - b2 + c2 - d2)) / ((b1 - c1) * (d2 - c2) - (d1 - c1) * (b2 - c2)) AS g,
        ((b1 - c1) * (a2 - b2 + c2 - d2) - (a1 - b1 + c1 - d1) * (b2 - c2)) / ((b1 - c1) * (d2 - c2) - (d1 - c1) * (b2 - c2)) AS h FROM q),
    corners AS (SELECT b.page, line, pos, x / 850.0 AS u, y / 1180.0 AS v, x, y FROM boxes b, unnest([x0, x1]) AS xs(x), unnest([y0, y1]) AS ys(y)),
    moved AS (SELECT page, line, pos, CASE WHEN g IS NULL THEN x ELSE ((b1 - a1 + g * b1) * u + (d1 - a1 + h * d1) * v + a1) / (g * u + h * v + 1) END AS x,
        CASE WHEN g IS NULL THEN y ELSE ((b2 - a2 + g * b2) * u + (d2 - a2 + h * d2) * v + a2) / (g * u + h * v + 1) END AS y FROM corners LEFT JOIN p USING (page))
    SELECT page, line, pos, round(min(x), 3) AS x0, round(min(y), 3) AS y0, round(max(x), 3) AS x1, round(max(y), 3) AS y1 FROM moved GROUP BY page, line, pos"""
)
def prep_original_boxes(spark, sf_dir):
    """Boxes of straightened sheets on the photographs that these were taken from."""
    b = boxes(spark, sf_dir).select("page", "line", "pos", "x0", "y0", "x1", "y1")
    pages = b.select("page").distinct().filter("page % 3 <> 0")
    matrix = geometry.sheet_to_page(F.array(*(F.expr(v).cast("double") for v in QUAD)), F.lit(850.0), F.lit(1180.0))
    return geometry.mapped(b, pages.select("page", matrix.alias("matrix")), "page", digits=3)
