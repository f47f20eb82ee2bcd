"""Coordinates of prepared pages back on their originals: 3x3 matrices per page, joined with the page's boxes.

A matrix is an array of nine numbers, row by row, that takes (x, y, 1) to a multiple of the new (x, y, 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def _cells(matrix: Column) -> list[Column]:
    return [F.get(matrix, F.lit(i)) for i in range(9)]


def project(matrix: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The point that a matrix takes (x, y) to; null where it lies at infinity."""
    m = _cells(matrix)
    depth = F.nullif(m[6] * x + m[7] * y + m[8], F.lit(0.0))
    return (m[0] * x + m[1] * y + m[2]) / depth, (m[3] * x + m[4] * y + m[5]) / depth


def inverse(matrix: Column) -> Column:
    """The matrix that undoes another; null for one that cannot be undone."""
    a, b, c, d, e, f, g, h, i = _cells(matrix)
    minors = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    whole = F.nullif(a * minors[0] + b * minors[3] + c * minors[6], F.lit(0.0))
    return F.when(whole.isNotNull(), F.array(*(m / whole for m in minors)))


def sheet_to_page(quad: Column, width: Column, height: Column) -> Column:
    """The matrix from an upright sheet of a size to its four corners on the original.

    `quad` holds x and y of the corners from the upper left on, clockwise. A quadrilateral without area
    gives null. For a rectangle this is a crop.
    """
    x0, y0, x1, y1, x2, y2, x3, y3 = (F.get(quad, F.lit(i)).cast("double") for i in range(8))
    right, left, rest = (x1 - x2, y1 - y2), (x3 - x2, y3 - y2), (x0 - x1 + x2 - x3, y0 - y1 + y2 - y3)
    area = F.nullif(right[0] * left[1] - left[0] * right[1], F.lit(0.0))
    g = (rest[0] * left[1] - left[0] * rest[1]) / area
    h = (right[0] * rest[1] - rest[0] * right[1]) / area
    across = [x1 - x0 + g * x1, y1 - y0 + g * y1, g]
    down = [x3 - x0 + h * x3, y3 - y0 + h * y3, h]
    cells = [v for i, at in enumerate((x0, y0, F.lit(1.0))) for v in (across[i] / width, down[i] / height, at)]
    return F.when(area.isNotNull() & (width > 0) & (height > 0), F.array(*cells))


def mapped(boxes: DataFrame, matrices: DataFrame, page: str, digits: int | None = None) -> DataFrame:
    """`boxes` with x0, y0, x1, y1 as the edges of what each page's matrix makes of their four corners.

    `matrices` has the page, once each, and matrix. Pages without one, or with a null one, keep their boxes. Pages meet
    their matrix in a join, so it is up to Spark how; a page with very many boxes is split like any skewed key.
    """
    m = F.coalesce("matrix", F.array(*(F.lit(v) for v in IDENTITY)))
    corners = [project(m, F.col(x), F.col(y)) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs, ys = ([c[i] for c in corners] for i in (0, 1))
    edges = {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}
    out = boxes.join(matrices.select(page, "matrix"), page, "left").withColumns(edges).drop("matrix")
    return out if digits is None else out.withColumns({c: F.round(c, digits) for c in edges})
