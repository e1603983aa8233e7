"""Geometry on columns: axis-aligned boxes in page pixels, points, segments, polylines."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    def padded(self, x: Column | float, y: Column | float | None = None) -> Box:
        y = x if y is None else y
        return Box(self.x0 - x, self.y0 - y, self.x1 + x, self.y1 + y)

    def shifted(self, dx: Column | float, dy: Column | float) -> Box:
        return Box(self.x0 + dx, self.y0 + dy, self.x1 + dx, self.y1 + dy)

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip(self._fields, self, strict=True)]


def box(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + n) for n in Box._fields))


def center(b: Box) -> tuple[Column, Column]:
    return (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2


def area(b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b.width) * F.greatest(zero, b.height)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 without a positive overlap."""
    w, h = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    both = w * h
    union = area(a) + area(b) - both
    return F.when((w > 0) & (h > 0) & (union > 0), F.try_divide(both, union)).otherwise(0.0)


def gap(a: Box, b: Box) -> Column:
    """Distance of two boxes; 0 if they touch, null if a corner is."""
    dx = F.greatest(F.lit(0.0), b.x0 - a.x1, a.x0 - b.x1)
    dy = F.greatest(F.lit(0.0), b.y0 - a.y1, a.y0 - b.y1)
    known = a.x0.isNotNull() & b.x0.isNotNull()
    return F.when(known, F.sqrt(dx * dx + dy * dy))


def inside(x: Column, y: Column, b: Box) -> Column:
    """Borders count."""
    return x.between(b.x0, b.x1) & y.between(b.y0, b.y1)


def intersect(a: Box, b: Box) -> Column:
    """A common area; touching doesn't count."""
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def contained(inner: Box, outer: Box, pad: float = 0.05) -> Column:
    """inner within outer, which is padded by a share of each side (of 1 at least)."""
    o = outer.padded(pad * F.greatest(F.lit(1.0), outer.width), pad * F.greatest(F.lit(1.0), outer.height))
    return (inner.x0 >= o.x0) & (inner.y0 >= o.y0) & (inner.x1 <= o.x1) & (inner.y1 <= o.y1)


def distance2(x: Column, y: Column, u: Column, v: Column) -> Column:
    return (x - u) * (x - u) + (y - v) * (y - v)


def foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on the line a-b the point's foot lies (0 at a, 1 at b, not clamped); 0 on a degenerate segment."""
    dx, dy = bx - ax, by - ay
    return F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), foot(px, py, ax, ay, bx, by)))
    return F.sqrt(distance2(px, py, ax + t * (bx - ax), ay + t * (by - ay)))


def crosses(ax: Column, ay: Column, bx: Column, by: Column, b: Box) -> Column:
    """Whether a segment has a point in the box, borders included: the interval of its parameter where it lies in both slabs isn't empty."""
    def slab(p: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
        s, t = F.try_divide(lo - p, d), F.try_divide(hi - p, d)
        return F.coalesce(F.least(s, t), F.lit(0.0)), F.coalesce(F.greatest(s, t), F.lit(1.0)), (d != 0) | p.between(lo, hi)

    x_in, x_out, x_ok = slab(ax, bx - ax, b.x0, b.x1)
    y_in, y_out, y_ok = slab(ay, by - ay, b.y0, b.y1)
    return x_ok & y_ok & (F.greatest(F.lit(0.0), x_in, y_in) <= F.least(F.lit(1.0), x_out, y_out))


def polyline_length(points: Column) -> Column:
    """points: array<struct<x, y>>."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def angle(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Degrees between two unit vectors."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ux * vx + uy * vy))))


def text_shaped(b: Box, low: float = 35.0, ratio: float = 2.5) -> Column:
    """Lower than a line of text and much wider than high."""
    return (b.height < low) & (F.try_divide(b.width, b.height) >= ratio)


def margin(b: Box, page_w: Column, page_h: Column, side: float = 0.16, edge: float = 0.10) -> Column:
    """side, edge or body, by the centre; body on a page of unknown size."""
    x, y = center(b)
    at_side = (x < side * page_w) | (x > (1 - side) * page_w)
    at_edge = (y < edge * page_h) | (y > (1 - edge) * page_h)
    return F.when(F.coalesce(at_side, F.lit(False)), "side").when(F.coalesce(at_edge, F.lit(False)), "edge").otherwise("body")


def union_box(a: Box, b: Box, pad: float, page_w: float, page_h: float) -> Box:
    """Both boxes and a margin, within the page."""
    return Box(F.greatest(F.lit(0.0), F.least(a.x0, b.x0) - pad), F.greatest(F.lit(0.0), F.least(a.y0, b.y0) - pad), F.least(F.lit(page_w), F.greatest(a.x1, b.x1) + pad), F.least(F.lit(page_h), F.greatest(a.y1, b.y1) + pad))


def downscale(w: Column, h: Column, most: float) -> Column:
    return F.least(F.lit(1.0), F.try_divide(F.lit(most), F.greatest(w, h)))
