"""Polygons (array<array<double>> of [x, y]) and boxes (x, y, w, h) as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _x(p):
    return p[0]


def _y(p):
    return p[1]


def signed_area(poly: Column) -> Column:
    """Shoelace area, positive for one turning sense; fewer than three points have none."""
    turned = F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1))
    cross = F.zip_with(poly, turned, lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.when(F.size(poly) < 3, 0.0).otherwise(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2)


def area(poly: Column) -> Column:
    return F.abs(signed_area(poly))


def bbox(poly: Column) -> Column:
    """struct<x, y, w, h> around a polygon."""
    xs, ys = F.transform(poly, _x), F.transform(poly, _y)
    return F.struct(
        F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h")
    )


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The corners clockwise from the top left."""
    return F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))


def default_baseline(poly: Column, share: float = 0.78) -> Column:
    """A level line at a share of the polygon's height."""
    b = bbox(poly)
    y = b["y"] + b["h"] * F.lit(share)
    return F.array(F.array(b["x"], y), F.array(b["x"] + b["w"], y))


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    """Common area of two boxes given as corners (x1, y1, x2, y2)."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes given as corners; empty boxes give 0."""
    size = lambda c: F.greatest(c[2] - c[0], F.lit(0.0)) * F.greatest(c[3] - c[1], F.lit(0.0))
    common = box_overlap(a, b)
    union = size(a) + size(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def shoelace(poly: list) -> float:
    n = len(poly)
    return sum(poly[i][0] * poly[(i + 1) % n][1] - poly[(i + 1) % n][0] * poly[i][1] for i in range(n)) / 2 if n > 2 else 0.0


def clip_convex(subject: list, window: list) -> list:
    """The part of a polygon inside a convex window: the polygon is cut by each edge's half plane in turn."""
    if len(subject) < 3 or len(window) < 3:
        return []
    turn = 1.0 if shoelace(window) >= 0 else -1.0
    part = [tuple(p) for p in subject]
    for k, start in enumerate(window):
        end = window[(k + 1) % len(window)]
        ex, ey = end[0] - start[0], end[1] - start[1]
        # signed distance from the edge; inside is not below zero, by a hair
        side = [turn * (ex * (y - start[1]) - ey * (x - start[0])) for x, y in part]
        cut = []
        for i, (p, d) in enumerate(zip(part, side)):
            q, e = part[i - 1], side[i - 1]
            if (d >= -1e-9) != (e >= -1e-9):
                t = e / (e - d) if abs(e - d) > 1e-12 else 1.0
                cut.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if d >= -1e-9:
                cut.append(p)
        part = cut
        if not part:
            break
    return part


def polygon_iou(a: list | None, b: list | None) -> float:
    """Intersection over union, the second polygon taken as convex window; 0 where an area is 0."""
    if a is None or b is None:
        return 0.0
    one, two = abs(shoelace(a)), abs(shoelace(b))
    if one <= 0 or two <= 0:
        return 0.0
    common = abs(shoelace(clip_convex(a, b)))
    union = one + two - common
    return common / union if union > 0 else 0.0


@F.pandas_udf(T.DoubleType())
def polygon_iou_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    as_list = lambda p: None if p is None else [tuple(map(float, q)) for q in p]
    return pd.Series([polygon_iou(as_list(x), as_list(y)) for x, y in zip(a, b)])


def points_text(poly: Column) -> Column:
    """`x,y x,y` with at most two decimals."""
    number = lambda v: F.round(v, 2).cast("double").cast("string")
    return F.array_join(F.transform(poly, lambda p: F.concat(number(p[0]), F.lit(","), number(p[1]))), " ")


def corners_to_coco(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct<x, y, w, h>, not below zero, to one decimal."""
    r = lambda v: F.round(F.greatest(v, F.lit(0.0)), 1)
    return F.struct(r(x1).alias("x"), r(y1).alias("y"), r(x2 - x1).alias("w"), r(y2 - y1).alias("h"))


def coco_to_corners(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x, y, x + w, y + h]


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """struct of the box inside the image, null if nothing is left."""
    a, b = F.greatest(F.lit(0.0), F.least(x1, width)), F.greatest(F.lit(0.0), F.least(y1, height))
    c, d = F.greatest(F.lit(0.0), F.least(x2, width)), F.greatest(F.lit(0.0), F.least(y2, height))
    return F.when((c > a) & (d > b), F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, pad: int, width: Column, height: Column) -> Column:
    """Whole-pixel box with padding, halves rounded to even, inside the image; an empty one is an error."""
    a = F.greatest(F.lit(0), F.rint(x1).cast("int") - pad)
    b = F.greatest(F.lit(0), F.rint(y1).cast("int") - pad)
    c = F.least(width.cast("int"), F.rint(x2).cast("int") + pad)
    d = F.least(height.cast("int"), F.rint(y2).cast("int") + pad)
    return F.when((c > a) & (d > b), F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))).otherwise(F.raise_error(F.lit("empty crop")))


def tiles(width: Column, height: Column, size: Column) -> Column:
    """array<struct<tx, ty>> of the tile grid that covers an image, row by row."""
    nx, ny = F.ceil(width / size).cast("int"), F.ceil(height / size).cast("int")
    return F.flatten(
        F.transform(F.sequence(F.lit(0), ny - 1), lambda y: F.transform(F.sequence(F.lit(0), nx - 1), lambda x: F.struct(x.alias("tx"), y.alias("ty"))))
    )


def megapixels(width: Column, height: Column) -> Column:
    return width * height / 1e6


def boundary_polygon(value: Column) -> Column:
    """A boundary given as points, or as four numbers for two corners, as a polygon; input is array<array<double>>, corners one array of four."""
    flat = F.flatten(value)
    corners = rectangle(flat[0], flat[1], flat[2] - flat[0], flat[3] - flat[1])
    return F.when((F.size(value) == 1) & (F.size(flat) == 4), corners).otherwise(value)
