"""Text lines of loose boxes, and numbers in them.

Pages are cut where boxes cannot affect each other, before anything is decided in order: tall boxes into islands
of overlapping heights, lines with the small marks around them into strips, parts of a glyph into islands of
overlapping widths. What is one task's group is such a piece, never a page.
"""

from __future__ import annotations

import math
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verso.session import written

#: A box begins a line from this part of the page's text height on, and from this height on; fixed by the blueprint.
SEED, LEAST_SEED = 0.62, 6.0
#: A line takes a tall box that shares this part of the lower of both heights.
SHARE = 0.5
#: A line of fewer boxes is widened by any box, a longer one by boxes of up to so many times its median height.
YOUNG, OUTSIZED = 6, 2.0
#: Boxes that are so many heights below a line end the search upwards (its low and its top edge).
ABOVE_LOW, ABOVE_TOP = 4, 6
#: A small mark belongs to a line whose band, widened by this part of its height, holds its middle.
REACH = 0.35
#: A line is taken apart if its band is so many times its median height and it has so many boxes.
SWOLLEN, SEVERAL = 1.7, 6
#: Neighbours: boxes that come next from left to right, at most so many heights away, with so much height in common.
AHEAD, AWAY, COMMON = 24, 1.5, 0.4
#: Numbers: width and height of a digit, widest gap, height of one that counts, how many of them, least text height.
DIGIT_W, DIGIT_H, GAP, COUNTS, DIGITS, LEAST_TEXT = 1.15, 1.4, 0.9, 0.5, 3, 8
#: The height that a line's digits are measured by stands at this place of its sorted heights.
TALL_PLACE = 0.8


def height() -> Column:
    return F.col("y1") - F.col("y0")


def marked_tall(boxes: DataFrame, page: str) -> DataFrame:
    """Add tall: whether a box may begin a line. On a page of nothing but small marks all are tall.

    The text height is the median of the upper half of all heights, so that specks do not lower it.
    """
    half = boxes.groupBy(page).agg(F.median(height()).alias("_half"))
    upper = boxes.join(half, page).filter(height() >= F.col("_half"))
    text = upper.groupBy(page).agg(F.greatest(F.lit(LEAST_SEED), F.median(height()) * SEED).alias("_seed"), F.max(height()).alias("_most"))
    tall = (height() >= F.col("_seed")) | (F.col("_most") < F.col("_seed"))
    return boxes.join(text, page).withColumn("tall", tall).drop("_seed", "_most")


def islands(rows: DataFrame, keys: list[str], low: Column, high: Column, order: list[str], name: str, touch: bool = False) -> DataFrame:
    """Add `name`, the number of the run of overlapping ranges (also touching ones with `touch`) within the keys."""
    sweep = Window.partitionBy(*keys).orderBy(low, high, *order)
    before = F.max(high).over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    begins = before.isNull() | ((low > before) if touch else (low >= before))
    return rows.withColumn("_begins", begins.cast("int")).withColumn(name, F.sum("_begins").over(sweep)).drop("_begins")


class _Band:
    """A line while it grows: its edges and the heights of its boxes."""

    def __init__(self, box, y0: float, y1: float, at: float) -> None:
        self.box, self.top, self.low, self.at, self.heights = box, y0, y1, at, [y1 - y0]  # heights are sorted

    def take(self, y0: float, y1: float) -> None:
        insort(self.heights, y1 - y0)
        n = len(self.heights)
        if (y0 < self.top or y1 > self.low) and (n < YOUNG or y1 - y0 <= OUTSIZED * (self.heights[(n - 1) // 2] + self.heights[n // 2]) / 2):
            self.top, self.low = min(self.top, y0), max(self.low, y1)


#: Bands of an island up to which they are looked at one by one.
FEW = 16


def _fitting(bands: list[_Band], y0: float, y1: float) -> int:
    """The place of the band that takes a tall box, -1 for none: the last of those that share most of its height."""
    h, most, place = y1 - y0, 0, -1
    for k in range(len(bands) - 1, -1, -1):
        top, low = bands[k].top, bands[k].low
        if low < y0 - ABOVE_LOW * h and top < y0 - ABOVE_TOP * h:
            break
        common = min(low, y1) - max(top, y0)
        if common > most and common >= SHARE * min(low - top, h):
            most, place = common, k
    return place


def _fitting_of_many(edges: np.ndarray, y0: float, y1: float) -> int:
    """`_fitting` on the tops and lows of many bands."""
    h, (top, low) = y1 - y0, edges
    gone = np.flatnonzero((low < y0 - ABOVE_LOW * h) & (top < y0 - ABOVE_TOP * h))
    first = gone[-1] + 1 if len(gone) else 0
    common = np.minimum(low, y1) - np.maximum(top, y0)
    fits = (common > 0) & (common >= SHARE * np.minimum(low - top, h)) & (np.arange(len(top)) >= first)
    return int(np.flatnonzero(fits & (common == common[fits].max()))[-1]) if fits.any() else -1


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tall boxes, sorted by page, island, middle and box, with their band and its edges so far."""
    here, bands, edges = None, [], np.zeros((2, 2 * FEW))
    for pdf in batches:
        found = []
        for page, island, box, y0, y1 in zip(*(pdf[c].tolist() for c in ("page", "_island", "box", "y0", "y1")), strict=True):
            if (page, island) != here:
                here, bands = (page, island), []
            k = _fitting(bands, y0, y1) if len(bands) <= FEW else _fitting_of_many(edges[:, : len(bands)], y0, y1)
            if k >= 0:
                bands[k].take(y0, y1)
            else:
                k = len(bands)
                bands.append(_Band(box, y0, y1, (y0 + y1) / 2))
                if k == edges.shape[1]:
                    edges = np.concatenate([edges, np.zeros_like(edges)], axis=1)
            edges[:, k] = bands[k].top, bands[k].low
            found.append((bands[k].box, float(bands[k].top), float(bands[k].low), float(bands[k].at)))
        yield pdf.assign(**{c: list(v) for c, v in zip(("band", "top", "low", "seed_at"), zip(*found, strict=True), strict=True)}) if found else pdf.iloc[:0].assign(band=[], top=[], low=[], seed_at=[])


def _in_runs(rows: DataFrame, keys: list[str], order: list, run, schema: str) -> DataFrame:
    """`rows` dealt by the keys and sorted by them and `order`, as a stream through `run`.

    Dealt by number, as the work of a row is in Python and far more than its bytes tell.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _schema(rows: DataFrame, more: dict[str, str]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in ({f.name: f.dataType.simpleString() for f in rows.schema.fields} | more).items())


def line_bands(boxes: DataFrame, page: str) -> DataFrame:
    """The tall boxes with band (the box that began it), top, low, seed_at and text_h of their band.

    `boxes` has the page, box (a number of its own on the page) and x0, y0, x1, y1. In the order of their middles,
    boxes join the band that shares most of their height, or begin one. Bands grow with their boxes.
    """
    tall = marked_tall(_plain(boxes, page), "page").filter("tall").drop("tall")
    cut = islands(tall, ["page"], F.col("y0"), F.col("y1"), ["box"], "_island")
    more = {"band": dict(cut.dtypes)["box"], "top": "double", "low": "double", "seed_at": "double"}
    grown = _in_runs(cut, ["page", "_island"], [F.col("y0") + F.col("y1"), "box"], _banded, _schema(cut, more)).drop("_island")
    # Edges only move outwards, so a band's last edges are its outermost.
    whole = Window.partitionBy("page", "band")
    edges = {"top": F.min("top").over(whole), "low": F.max("low").over(whole), "text_h": F.median(height()).over(whole)}
    return grown.withColumns(edges).withColumnRenamed("page", page)


def _plain(boxes: DataFrame, page: str) -> DataFrame:
    return boxes.select(F.col(page).alias("page"), "box", "x0", "y0", "x1", "y1")


class _Along:
    """Boxes that come in the order of their left edges, for the gap between them and another box."""

    def __init__(self) -> None:
        self.lefts, self.reach = [], []  # reach: the outermost right edge so far

    def add(self, x0: float, x1: float) -> None:
        self.lefts.append(x0)
        self.reach.append(max(x1, self.reach[-1]) if self.reach else x1)

    def gap(self, x0: float, x1: float) -> float:
        k = bisect_right(self.lefts, x1)
        before = max(x0 - self.reach[k - 1], 0) if k else math.inf
        return min(before, self.lefts[k] - x1) if k < len(self.lefts) else before


def _attached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Boxes sorted by page, strip, tall ones first, left edge and box; small marks get the nearest band.

    Nearest is by the gap to a band's boxes, those that joined before included, then by height.
    """
    here, bands = None, {}  # band -> (seed_at, top, low, tall boxes, marks)
    for pdf in batches:
        chosen = []
        columns = ("page", "strip", "x0", "y0", "x1", "y1", "band", "top", "low", "seed_at")
        for page, strip, x0, y0, x1, y1, band, top, low, at in zip(*(pdf[c].tolist() for c in columns), strict=True):
            if (page, strip) != here:
                here, bands = (page, strip), {}
            tall = at == at and at is not None  # marks have no number here
            if tall:
                bands.setdefault(band, (at, top, low, _Along(), _Along()))
            else:
                middle, best = (y0 + y1) / 2, None
                for name, (seed_at, upper, lower, *boxes) in bands.items():
                    if upper - REACH * (lower - upper) <= middle <= lower + REACH * (lower - upper):
                        rank = (min(along.gap(x0, x1) for along in boxes), abs(middle - (upper + lower) / 2), seed_at, name)
                        best = rank if best is None else min(best, rank)
                band = best[3] if best else None
            if band is not None:
                bands[band][3 if tall else 4].add(x0, x1)
            chosen.append(band)
        yield pdf[["page", "box", "x0", "y0", "x1", "y1"]].assign(band=pd.Series(chosen, dtype=object))


def _with_marks(boxes: DataFrame, tall: DataFrame, page: str) -> DataFrame:
    """(page, box, x0, y0, x1, y1, band) of all boxes; band is null for a mark that no line is near."""
    bands = tall.groupBy(page, "band").agg(*(F.first(c).alias(c) for c in ("top", "low", "seed_at")))
    reach = REACH * (F.col("low") - F.col("top"))
    strips = islands(bands.withColumns({"_from": F.col("top") - reach, "_to": F.col("low") + reach}), [page], F.col("_from"), F.col("_to"), ["band"], "strip", touch=True)
    small = marked_tall(_plain(boxes, page), "page").filter("not tall").drop("tall").withColumnRenamed("page", page)
    begins = strips.groupBy(page, "strip").agg(F.min("_from").alias("_at"), F.max("_to").alias("_to"))
    # Marks meet the strip that begins last above their middle, as one sweep down the page.
    nothing = [F.lit(None).cast(t).alias(n) for n, t in small.dtypes if n != page]
    events = begins.select(page, *nothing, "_at", F.lit(0).alias("_kind"), "strip", "_to").unionByName(
        small.withColumns({"_at": (F.col("y0") + F.col("y1")) / 2, "_kind": F.lit(1), "strip": F.lit(None).cast("long"), "_to": F.lit(None).cast("double")})
    )
    sweep = Window.partitionBy(page).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_kind") == 0, F.struct("strip", "_to")), ignorenulls=True).over(sweep)
    marks = events.withColumn("_last", last).filter("_kind = 1")
    marks = marks.select(page, "box", "x0", "y0", "x1", "y1", F.when(F.col("_at") <= F.col("_last._to"), F.col("_last.strip")).alias("strip"))
    kind = dict(tall.dtypes)["band"]
    placed = tall.join(strips.select(page, "band", "strip"), [page, "band"])
    shared = ("top", "low", "seed_at")
    both = placed.select(page, "box", "x0", "y0", "x1", "y1", "strip", "band", *shared).unionByName(
        marks.filter("strip is not null").withColumns({"band": F.lit(None).cast(kind), **{c: F.lit(None).cast("double") for c in shared}})
    )
    both = both.withColumnRenamed(page, "page").withColumn("_mark", F.col("band").isNull())
    schema = _schema(both.select("page", "box", "x0", "y0", "x1", "y1", "band"), {})
    found = _in_runs(both, ["page", "strip"], ["_mark", "x0", "box"], _attached, schema).withColumnRenamed("page", page)
    return found.unionByName(marks.filter("strip is null").drop("strip").withColumn("band", F.lit(None).cast(kind)))


def neighbour_links(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): boxes and those of the next `AHEAD` to their right, up to the first that is far, that share height."""
    ahead = Window.partitionBy(*keys).orderBy("x0", "box").rowsBetween(1, AHEAD)
    nexts = F.collect_list(F.struct("box", "x0", "y0", "y1")).over(ahead)
    own = height()
    other = lambda b: b["y1"] - b["y0"]
    far = F.array_position(F.transform("_next", lambda b: b["x0"] - F.col("x1") > AWAY * F.greatest(own, other(b))), True)
    close = F.when(far > 0, F.slice("_next", 1, (far - 1).cast("int"))).otherwise(F.col("_next"))
    share = lambda b: F.least(F.col("y1"), b["y1"]) - F.greatest(F.col("y0"), b["y0"]) >= COMMON * F.least(own, other(b))
    linked = boxes.withColumn("_next", nexts).select(*keys, F.col("box").alias("a"), F.explode(F.filter(close, share)).alias("_b"))
    return linked.select(*keys, "a", F.col("_b.box").alias("b"))


class _Groups:
    """Boxes of one line that come from left to right, and the groups that their links make so far."""

    def __init__(self) -> None:
        self.boxes, self.parent, self.near = [], [], []  # near: (place, x1, y0, y1) of boxes that may still be linked

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def add(self, box, x0: float, x1: float, y0: float, y1: float) -> None:
        k, h, near = len(self.boxes), y1 - y0, []
        self.boxes.append(box)
        self.parent.append(k)
        for other in self.near:
            at, right, top, low = other
            if k - at > AHEAD or x0 - right > AWAY * max(h, low - top):
                continue
            near.append(other)
            if min(y1, low) - max(y0, top) >= COMMON * min(h, low - top):
                a, b = self.root(at), self.root(k)
                if self.boxes[a] > self.boxes[b]:
                    a, b = b, a
                self.parent[b] = a  # a root is the least box of its group
        near.append((k, x1, y0, y1))
        self.near = near

    def least(self) -> list:
        return [self.boxes[self.root(k)] for k in range(len(self.boxes))]


def _neighbours(keys: list[str]):
    """Boxes sorted by line and from left to right, as a stream: the least box of the group of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, here, line = [], None, _Groups()
        for pdf in batches:
            found = []
            named = zip(*(pdf[k].tolist() for k in keys), strict=True)
            for key, *box in zip(named, *(pdf[c].tolist() for c in ("box", "x0", "x1", "y0", "y1")), strict=True):
                if key != here:
                    found += line.least()
                    here, line = key, _Groups()
                line.add(*box)
            held.append(pdf)
            if found:
                rows = pd.concat(held)
                yield rows.iloc[: len(found)].assign(line=found)
                held = [rows.iloc[len(found) :]]
        if line.boxes:
            yield pd.concat(held).assign(line=line.least())

    return run


def neighbour_groups(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """`boxes` with line, the least box that is reached over neighbour links (see `neighbour_links`) within the keys.

    A box is linked to some of the next ones only, so a line is one pass from left to right; what a task holds is one line.
    """
    return _in_runs(boxes, keys, ["x0", "box"], _neighbours(keys), _schema(boxes, {"line": dict(boxes.dtypes)["box"]}))


def text_lines(boxes: DataFrame, page: str = "page") -> DataFrame:
    """(page, box, x0, y0, x1, y1, line) of all boxes; line is the box that names the line, null for a stray mark.

    Tall boxes make bands, small marks join the nearest one. A band that is much taller than its boxes has
    swallowed a neighbour, as lines drift over a page; it is taken apart into groups of neighbours, each named
    by its least box. `boxes` has the page, box (a number of its own on the page) and the four edges, none null.
    """
    tall = written(line_bands(boxes, page), "bands")
    rows = written(_with_marks(boxes, tall, page), "lines")
    sizes = rows.groupBy(page, "band").agg(F.count(F.lit(1)).alias("_n"))
    shape = tall.groupBy(page, "band").agg(F.first("text_h").alias("_text"), F.first("low").alias("_low"), F.first("top").alias("_top"))
    swollen = sizes.join(shape, [page, "band"]).filter((F.col("_low") - F.col("_top") > SWOLLEN * F.col("_text")) & (F.col("_n") >= SEVERAL)).select(page, "band")
    whole = rows.join(swollen, [page, "band"], "left_anti").withColumn("line", F.col("band"))
    apart = neighbour_groups(rows.join(swollen, [page, "band"], "left_semi"), [page, "band"])
    return whole.unionByName(apart).drop("band")


def number_places(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x0, y0, x1, y1, n_boxes): runs of digit-like boxes on the lines given by the keys.

    A run ends at a box too wide or tall for a digit and at a gap, and counts if it has enough full-height boxes.
    Digits are measured by the height at four fifths of a line's sorted heights; lines of specks have no numbers.
    """
    ranked = Window.partitionBy(*keys).orderBy(height(), "box")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    heights = boxes.withColumn("_r", F.row_number().over(ranked)).withColumn("_n", size)
    text = heights.filter(F.col("_r") == F.floor(F.col("_n") * TALL_PLACE) + 1).select(*keys, height().alias("_text")).filter(F.col("_text") >= LEAST_TEXT)
    narrow = (F.col("x1") - F.col("x0") <= DIGIT_W * F.col("_text")) & (height() <= DIGIT_H * F.col("_text"))
    along = Window.partitionBy(*keys).orderBy("x0", "box")
    rows = boxes.join(text, keys).withColumn("_narrow", narrow)
    apart = F.col("x0") - F.lag("x1").over(along) > GAP * F.col("_text")
    cut = (~F.col("_narrow") | F.coalesce(apart, F.lit(True))).cast("int")
    runs = rows.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(along)).filter("_narrow")
    found = runs.groupBy(*keys, "_run").agg(
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.count(F.lit(1)).alias("n_boxes"),
        F.count_if(height() >= COUNTS * F.col("_text")).alias("_full"),
    )
    return found.filter(F.col("_full") >= DIGITS).drop("_run", "_full")


def _absorbed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Boxes sorted by run and then from the largest down, each with the first grown box that takes it in."""
    run, grown = None, []  # [box, x0, y0, x1, y1]
    for pdf in batches:
        into = []
        for at, box, x0, y0, x1, y1 in zip(*(pdf[c] for c in ("_run", "box", "x0", "y0", "x1", "y1")), strict=True):
            if at != run:
                run, grown = at, []
            for g in grown:
                common, tall = min(g[3], x1) - max(g[1], x0), g[4] - g[2]
                if common > 0 and 2 * common >= x1 - x0 and y1 >= g[2] - tall and y0 <= g[4] + tall:
                    g[1:] = min(g[1], x0), min(g[2], y0), max(g[3], x1), max(g[4], y1)
                    break
            else:
                grown.append(g := [box, x0, y0, x1, y1])
            into.append(g[0])
        yield pdf.assign(whole=into)


def absorbed(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """`boxes` with whole, the box that each is a part of (itself if of none), on the lines given by the keys.

    Parts that come off a glyph lie over or under its main stroke. From the largest box down, a box that shares
    half of its width with a grown box not more than that one's height away is taken in by the first such box,
    which grows. Only boxes that overlap in width can meet, so lines are cut into islands of them.
    """
    cut = islands(boxes, keys, F.col("x0"), F.col("x1"), ["box"], "_island")
    cut = cut.withColumn("_run", F.concat_ws(".", *keys, "_island"))
    area = (F.col("x1") - F.col("x0")) * height()
    found = _in_runs(cut, ["_run"], [area.desc(), "box"], _absorbed, _schema(cut, {"whole": dict(cut.dtypes)["box"]}))
    return found.drop("_island", "_run")
