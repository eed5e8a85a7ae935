"""Geometry as column arithmetic: points, segments, boxes. Boxes are closed; coordinates are doubles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in cls._fields))

    def grown(self, by) -> Box:
        return Box(self.x0 - by, self.y0 - by, self.x1 + by, self.y1 + by)

    @property
    def centre(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    @property
    def area(self) -> Column:
        return (self.x1 - self.x0) * (self.y1 - self.y0)

    @property
    def diagonal(self) -> Column:
        return F.hypot(self.x1 - self.x0, self.y1 - self.y0)

    @property
    def longest(self) -> Column:
        return F.greatest(self.x1 - self.x0, self.y1 - self.y0)

    @property
    def minor(self) -> Column:
        return F.least(self.x1 - self.x0, self.y1 - self.y0)

    def contains(self, x: Column, y: Column) -> Column:
        return x.between(self.x0, self.x1) & y.between(self.y0, self.y1)

    def meets(self, o: Box) -> Column:
        return (self.x0 <= o.x1) & (o.x0 <= self.x1) & (self.y0 <= o.y1) & (o.y0 <= self.y1)


def length(ax, ay, bx, by) -> Column:
    return F.hypot(bx - ax, by - ay)


def folded_angle(ax, ay, bx, by) -> Column:
    """Direction of a segment without its sense, in [0, pi)."""
    return F.pmod(F.atan2(by - ay, bx - ax), F.lit(3.141592653589793))


def iou(a: Box, b: Box) -> Column:
    w = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0.0))
    h = F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0.0))
    union = a.area + b.area - w * h
    return F.when((w > 0) & (h > 0) & (union > 0), w * h / union).otherwise(0.0)


def rect_gap(a: Box, b: Box) -> Column:
    """Distance between two boxes, 0 where they touch."""
    zero = F.lit(0.0)
    return F.hypot(F.greatest(a.x0 - b.x1, b.x0 - a.x1, zero), F.greatest(a.y0 - b.y1, b.y0 - a.y1, zero))


def along(px, py, ax, ay, bx, by) -> Column:
    """Where a point projects on a segment, from 0 at its start to 1 at its end."""
    dx, dy = bx - ax, by - ay
    sq = dx * dx + dy * dy
    return F.when(sq <= TINY, 0.0).otherwise(F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / F.greatest(sq, F.lit(TINY)), F.lit(0.0)), F.lit(1.0)))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Beside a segment its distance comes from the cross product, beyond it from the nearer end; no foot point is computed,
    so that points equally far from segments along the axes get equal numbers."""
    dx, dy = bx - ax, by - ay
    sq, dot = dx * dx + dy * dy, (px - ax) * dx + (py - ay) * dy
    to = lambda x, y: F.sqrt((px - x) * (px - x) + (py - y) * (py - y))
    beside = F.abs((px - ax) * dy - (py - ay) * dx) / F.sqrt(F.greatest(sq, F.lit(TINY)))
    return F.when((sq <= TINY) | (dot <= 0), to(ax, ay)).when(dot >= sq, to(bx, by)).otherwise(beside)


def segment_meets(ax, ay, bx, by, box: Box) -> Column:
    """A segment touches a box: the parameter ranges in which it is between the box's sides overlap in [0, 1]."""

    def side(a, b, lo, hi):
        d = b - a
        flat = F.abs(d) < TINY
        safe = F.when(flat, F.lit(1.0)).otherwise(d)
        p, q = (lo - a) / safe, (hi - a) / safe
        within = a.between(lo, hi)
        enter = F.when(flat, F.when(within, 0.0).otherwise(2.0)).otherwise(F.least(p, q))
        leave = F.when(flat, F.when(within, 1.0).otherwise(-1.0)).otherwise(F.greatest(p, q))
        return enter, leave

    (ex, lx), (ey, ly) = side(ax, bx, box.x0, box.x1), side(ay, by, box.y0, box.y1)
    return F.greatest(ex, ey, F.lit(0.0)) <= F.least(lx, ly, F.lit(1.0))


def wilson(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of a proportion; (0, 0) without trials."""
    n = F.greatest(total, F.lit(1)).cast("double")
    p = hits / n
    mid, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    bound = lambda v: F.when(total > 0, F.least(F.greatest(v / scale, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return bound(mid - spread), bound(mid + spread)
