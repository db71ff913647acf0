"""Points in rectangles of a table, by an equi-join of cells.

A rectangle is put into the cells that it meets of the grid whose cells are as wide as it
is or up to twice as wide: two by two of them at most. A point has one cell in each of
the grids that some rectangle uses. Whether it is in the rectangle is tested on what
meets in a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwell import functions as G


def _level(r: DataFrame) -> Column:
    """The power of two that is no less than a rectangle's longer side."""
    longer = F.greatest(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"), F.lit(1e-300))
    return F.ceil(F.log2(longer)).cast("int")


def points_in(points: DataFrame, rectangles: DataFrame, closed: bool = True) -> DataFrame:
    """(pid, id, px, py) and the rectangle ``r`` for every point (id, x, y) in a rectangle
    (pid, x, y, x2, y2) of finite sides, its edges included if ``closed``.

    Rectangles without extent hold points if ``closed``; nulls are nowhere.
    """
    sized = rectangles.select("pid", "x", "y", "x2", "y2").na.drop().where("x <= x2 and y <= y2").withColumn("level", _level(rectangles))
    # one number for each binary order of magnitude among the sides
    levels = sorted(r["level"] for r in sized.select("level").distinct().collect())
    side = F.pow(F.lit(2.0), F.col("level"))
    cells = lambda a, z: F.sequence(F.floor(F.col(a) / side).cast("long"), F.floor(F.col(z) / side).cast("long"))
    r = F.struct("x", "y", "x2", "y2").alias("r")
    placed = sized.select("pid", "level", r, F.explode(cells("x", "x2")).alias("cx"), "y", "y2").select("pid", "level", "r", "cx", F.explode(cells("y", "y2")).alias("cy"))
    asked = points.select("id", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    asked = asked.withColumns({c: F.floor(F.col(p) / side).cast("long") for c, p in (("cx", "px"), ("cy", "py"))})
    inside = G.contains if closed else G.contains_open
    return asked.join(placed, ["level", "cx", "cy"]).where(inside(F.col("px"), F.col("py"), F.col("r"))).select("pid", "id", "px", "py", "r")


def rectangles_in(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(outer_pid, inner_pid): pairs of which the first holds the second as a whole; found by its corner."""
    whole = inner.select(F.struct("pid", "x", "y", "x2", "y2").alias("id"), "x", "y")
    met = points_in(whole, outer).where(G.contains_rect(F.col("r"), F.col("id")))
    return met.select(F.col("pid").alias("outer_pid"), F.col("id.pid").alias("inner_pid"))
