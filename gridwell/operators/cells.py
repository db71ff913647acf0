"""DBSCAN on cells: work that grows with the points however dense they are.

Cells are eps / sqrt(2) wide, so that all points of one lie within eps of each other. One
of ``min_points`` points or more is full: its points are all core points of one cluster,
and it is one vertex. Only the points of other cells, fewer than ``min_points`` in each,
are compared one by one, and of a full cell only with points that its bounding box
leaves open. Two full cells are linked by a nearest-pair test: boxes of their points are
told apart or found close enough as they are, and what stays open is cut finer, until the
first pair of boxes decides or so few points are left that they are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwell.functions import cell_side, dist2
from gridwell.operators.components import connected_components
from gridwell.operators.neighbors import with_cells
from gridwell.session import written

#: Pairs of points that are compared instead of cutting two boxes finer.
COMPARED = 256
#: Halvings of a cell's side in a round, and at most.
FINER, FINEST = 2, 40

_HALF = [(i, j) for i in range(3) for j in range(-2, 3) if i > 0 or j > 0]
_ALL = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]


def box_columns() -> list[Column]:
    """The bounding box of a group's points, and how many they are."""
    return [F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.count("*").alias("n")]


def farthest(a: str, b: str) -> Column:
    """The largest squared distance that two boxes (prefixes of x1, x2, y1, y2) allow."""
    dx = F.greatest(F.col(f"{a}x2") - F.col(f"{b}x1"), F.col(f"{b}x2") - F.col(f"{a}x1"))
    dy = F.greatest(F.col(f"{a}y2") - F.col(f"{b}y1"), F.col(f"{b}y2") - F.col(f"{a}y1"))
    return dx * dx + dy * dy


def nearest(a: str, b: str) -> Column:
    """The smallest squared distance that two boxes allow."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{b}{c}1") - F.col(f"{a}{c}2"), F.col(f"{a}{c}1") - F.col(f"{b}{c}2"))
    return gap("x") * gap("x") + gap("y") * gap("y")


def _around(steps: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in steps)))


def _prefixed(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in columns))


BOX = ("x1", "x2", "y1", "y2", "n")


@dataclass(frozen=True)
class _Graph:
    """The graph of cells: points in their cells, full cells (with the id of a ``first``
    point), what each other point is next to (``to_full``: id, first, n; ``to_sparse``:
    id, other), ids of core points outside full cells, and edges (src, dst) that make
    the components of all core points, of a full cell by its first alone."""

    placed: DataFrame
    full: DataFrame
    to_full: DataFrame
    to_sparse: DataFrame
    core: DataFrame
    edges: DataFrame


def _graph(points: DataFrame, eps: float, min_points: int) -> _Graph:
    side, limit = cell_side(eps), F.lit(eps * eps)
    placed = with_cells(points.select("id", "x", "y"), side)
    cells = placed.groupBy("cx", "cy").agg(*box_columns(), F.min("id").alias("first"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    # a full cell's box is checked, as rounding at its edges may make it wider than eps
    cells = written(cells.withColumn("full", (F.col("n") >= min_points) & (dx * dx + dy * dy <= limit)), "cells")
    full = cells.where("full").drop("full")
    sparse = written(placed.join(cells.where("not full").select("cx", "cy"), ["cx", "cy"]), "sparse")
    asked = sparse.select("id", "x", "y", _around(_ALL).alias("c")).select("id", "x", "y", "c.*")
    # a single point is a box, too
    asked = asked.withColumns({"px1": F.col("x"), "px2": F.col("x"), "py1": F.col("y"), "py2": F.col("y")})
    met = asked.join(full.withColumnsRenamed({c: f"c{c}" for c in BOX}), ["cx", "cy"]).where(nearest("p", "c") <= limit)
    met = written(met.select("id", "x", "y", "cx", "cy", "first", F.col("cn").alias("n"), (farthest("p", "c") <= limit).alias("whole")), "met")
    of_full = placed.join(met.where("not whole").select("cx", "cy").distinct(), ["cx", "cy"], "left_semi").select("cx", "cy", F.col("x").alias("qx"), F.col("y").alias("qy"))
    close = dist2(F.col("x"), F.col("y"), F.col("qx"), F.col("qy")) <= limit
    some = met.where("not whole").join(of_full, ["cx", "cy"]).where(close).groupBy("id", "first").agg(F.count("*").alias("n"))
    to_full = written(met.where("whole").select("id", "first", "n").union(some), "to_full")
    others = sparse.select("cx", "cy", F.col("id").alias("other"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    to_sparse = written(asked.join(others, ["cx", "cy"]).where(close).select("id", "other"), "to_sparse")
    counts = to_full.select("id", "n").union(to_sparse.groupBy("id").agg(F.count("*").alias("n")))
    core = written(counts.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_points).select("id"), "core")
    of_core = lambda df: df.join(core, "id")
    between = of_core(to_sparse.where("id < other")).join(core.withColumnRenamed("id", "other"), "other").select(F.col("id").alias("src"), F.col("other").alias("dst"))
    edges = _linked(placed, full, side, eps).union(of_core(to_full).select("id", "first")).union(between)
    return _Graph(placed, full, to_full, to_sparse, core, edges)


def cell_graph(points: DataFrame, eps: float, min_points: int) -> tuple[DataFrame, DataFrame]:
    """(core, component) of :func:`dbscan_cells`: ids of core points, and id and component
    of all points that have a cluster; a component's name is its smallest core id.

    ``points`` (id, x, y) are read several times, so they should come from a table.
    """
    core, inside, next_to = cell_clusters(points, eps, min_points)
    return core, inside.union(next_to.groupBy("id").agg(F.min("component").alias("component")))


def cell_clusters(points: DataFrame, eps: float, min_points: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids of core points; (id, component) of those; and the same of each component that
    another point is next to, of which a point has fewer than ``min_points``."""
    g = _graph(points, eps, min_points)
    vertices = g.full.select(F.col("first").alias("id")).union(g.core)
    found = vertices.join(connected_components(g.edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    found = written(found, "components")
    next_to = g.to_full.select("id", F.col("first").alias("other")).union(g.to_sparse).join(g.core, "id", "left_anti")
    border = next_to.join(found.withColumnRenamed("id", "other"), "other").select("id", "component").distinct()
    of_cell = g.full.select("cx", "cy", F.col("first").alias("id")).join(found, "id").drop("id")
    inside = g.placed.join(of_cell, ["cx", "cy"]).select("id", "component")
    cores = inside.select("id").union(g.core)
    return cores, inside.union(found.join(g.core, "id")), border


def cell_links(points: DataFrame, eps: float) -> DataFrame:
    """(src, dst): edges, src < dst, that make the same components as all pairs of points
    within eps of each other, in proportion to the points however dense they are.

    The points of a cell are linked to its first, and the firsts of two cells to each
    other if any pair of the cells' points is so near; theirs may be farther apart. A
    way along all pairs is at most three times as long along these.
    """
    g = _graph(points, eps, 1)
    star = g.placed.join(g.full.select("cx", "cy", "first"), ["cx", "cy"]).select(F.col("id").alias("src"), F.col("first").alias("dst"))
    every = g.edges.union(star).where("src != dst")
    return every.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _linked(placed: DataFrame, full: DataFrame, side: float, eps: float) -> DataFrame:
    """(src, dst): first ids of full cells of which some points are within eps of each other."""
    limit = F.lit(eps * eps)
    two = _prefixed(full, "b", *BOX, "first").join(full.select(F.col("first").alias("bfirst"), "cx", "cy"), "bfirst")
    near = full.select(*(F.col(c).alias("a" + c) for c in (*BOX, "first")), _around(_HALF).alias("c")).select("*", "c.*").drop("c").join(two, ["cx", "cy"]).drop("cx", "cy")
    near = written(near.where(nearest("a", "b") <= limit).withColumn("linked", farthest("a", "b") <= limit), "near")
    links = near.where("linked").select(F.col("afirst").alias("src"), F.col("bfirst").alias("dst"))
    open_ = near.where("not linked").drop("linked").withColumns({c: F.lit(0).cast("long") for c in ("ai", "aj", "bi", "bj")})
    by_cell = placed.join(full.select("cx", "cy", "first"), ["cx", "cy"])
    depth = 0
    # boxes (i, j) of a cell are those of a grid that is 2^depth times as fine; at 0 the cell is one
    while not open_.isEmpty():
        few = F.col("an") * F.col("bn") <= COMPARED if depth < FINEST else F.lit(True)
        ends = open_.select(F.col("afirst").alias("first")).union(open_.select("bfirst")).distinct()
        held = by_cell.join(ends, "first", "left_semi")
        at = lambda d: [(F.floor(F.col(c) / F.lit(side / (1 << d))).cast("long") if d else F.lit(0).cast("long")) for c in ("x", "y")]
        i, j = at(depth)
        own = held.select("first", i.alias("i"), j.alias("j"), "x", "y")
        compared = open_.where(few).select("afirst", "ai", "aj", "bfirst", "bi", "bj")
        compared = compared.join(_prefixed(own, "a", "first", "i", "j", "x", "y"), ["afirst", "ai", "aj"]).join(_prefixed(own, "b", "first", "i", "j", "x", "y"), ["bfirst", "bi", "bj"])
        compared = compared.where(dist2(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= limit).select("afirst", "bfirst")
        depth += FINER
        k, m = at(depth)
        finer = written(held.groupBy("first", i.alias("i"), j.alias("j"), k.alias("k"), m.alias("m")).agg(*box_columns()), "finer")
        names = ("first", "i", "j", "k", "m", *BOX)
        cut = open_.where(~few).select("afirst", "ai", "aj", "bfirst", "bi", "bj").join(_prefixed(finer, "a", *names), ["afirst", "ai", "aj"]).join(_prefixed(finer, "b", *names), ["bfirst", "bi", "bj"])
        cut = written(cut.where(nearest("a", "b") <= limit).withColumn("linked", farthest("a", "b") <= limit), "cut")
        new = written(compared.union(cut.where("linked").select("afirst", "bfirst")).distinct(), "links")
        links = links.union(new)
        still = cut.where("not linked").join(new, ["afirst", "bfirst"], "left_anti")
        open_ = still.drop("linked", "ai", "aj", "bi", "bj").withColumnsRenamed({"ak": "ai", "am": "aj", "bk": "bi", "bm": "bj"})
    return links
