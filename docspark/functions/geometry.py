"""Boxes in pixels: structs of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*(c.cast("int").alias(n) for n, c in zip(SIDES, (x1, y1, x2, y2))))


def from_points(points: Column) -> Column:
    """The box around a polygon of [x, y] points; null without points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"]).cast("long") * F.greatest(F.lit(0), b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0), wide).cast("long") * F.greatest(F.lit(0), high)


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area, 0 without any."""
    joint = area(a) + area(b) - intersection(a, b)
    return F.when(joint == 0, 0.0).otherwise(intersection(a, b) / F.nullif(joint, F.lit(0)))


def ioa(a: Column, b: Column) -> Column:
    """Shared area over that of `a`, 0 if `a` has none."""
    return F.when(area(a) == 0, 0.0).otherwise(intersection(a, b) / F.nullif(area(a), F.lit(0)))


def clamp(b: Column, width: Column, height: Column) -> Column:
    """The box cut to an image; null if nothing is left."""
    cut = lambda c, most: F.greatest(F.lit(0), F.least(c, most))
    inside = box(cut(b["x1"], width), cut(b["y1"], height), cut(b["x2"], width), cut(b["y2"], height))
    return F.when((inside["x2"] > inside["x1"]) & (inside["y2"] > inside["y1"]), inside)
