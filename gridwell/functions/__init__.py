"""Column expressions on points, cells and rectangles (columns x, y, x2, y2)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = 0


def dist2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def cell(value: Column, side: float) -> Column:
    """Number of the half-open cell [k * side, (k + 1) * side) that holds a value."""
    return F.floor(value / F.lit(float(side))).cast("long")


def cell_side(eps: float) -> float:
    """Slightly less than eps / sqrt(2): points of a cell of this side are within eps of each other."""
    return eps / math.sqrt(2) * (1 - 1e-9)


def contains(px: Column, py: Column, r: Column) -> Column:
    """Closed containment of a point in a rectangle."""
    return px.between(r["x"], r["x2"]) & py.between(r["y"], r["y2"])


def contains_open(px: Column, py: Column, r: Column) -> Column:
    return (px > r["x"]) & (px < r["x2"]) & (py > r["y"]) & (py < r["y2"])


def contains_rect(outer: Column, inner: Column) -> Column:
    return (outer["x"] <= inner["x"]) & (outer["y"] <= inner["y"]) & (outer["x2"] >= inner["x2"]) & (outer["y2"] >= inner["y2"])


def shrink(r: Column, by: float) -> Column:
    """A rectangle with every side moved inwards; a negative amount grows it."""
    a = F.lit(float(by))
    return F.struct((r["x"] + a).alias("x"), (r["y"] + a).alias("y"), (r["x2"] - a).alias("x2"), (r["y2"] - a).alias("y2"))


def flag(core: Column, cluster: Column) -> Column:
    return F.when(core, "CORE").when(cluster != UNKNOWN, "BORDER").otherwise("NOISE")
