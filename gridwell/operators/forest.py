"""The hierarchy of density clusters as a minimum spanning forest.

Two core points are as far apart as the largest of their distance and their core
distances (mutual reachability). What OPTICS orders point by point, the minimum spanning
forest of that distance holds as a set: the edges up to a threshold join just the core
points that are one cluster at that threshold.

A forest of a part of the edges holds all of them that the whole forest needs. So each
partition of the points makes its own, with copies of the points around it, and hands on
fewer edges than it has points, however many neighbours those have. Tasks then cut down
what they get in the same way, and where that is too much for one, Borůvka's rounds
follow: each component takes its least edge to another, components that meet are one, and
edges within one are dropped, so that every round at least halves the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwell.operators.components import connected_components
from gridwell.operators.local import kth_distances, partition_forest, spanning
from gridwell.operators.partitioner import costs, placed, plan_partitions, replicate
from gridwell.session import drop_written, written

#: Edges that one task holds at once.
EDGES_AT_ONCE = 1 << 20
#: Points of a partition that makes its forest alone, unless they are in one cell.
POINTS_AT_ONCE = 20_000

_EDGE = "a long, b long, e struct<w: double, i: long, j: long>"


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The minimum spanning forest of a task's edges (a, b, e), as they came."""
    held = list(batches)
    if not held:
        return
    edges = pa.Table.from_batches(held).combine_chunks()
    ends, e = [edges.column(c).to_numpy() for c in "ab"], edges.column("e").combine_chunks()
    w, i, j = (e.field(f).to_numpy(zero_copy_only=False) for f in "wij")
    rank = np.empty(len(w), np.int64)
    rank[np.lexsort((j, i, w))] = np.arange(len(w))
    names, at = np.unique(np.concatenate(ends), return_inverse=True)
    yield from edges.take(pa.array(spanning(len(names), at[: len(w)], at[len(w) :], rank))).to_batches(max_chunksize=1 << 16)


def minimum_spanning_forest(edges: DataFrame, edges_at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """(i, j, w) of the forest of ``edges`` (i, j, w): of equal weights the smaller (i, j) comes first.

    Loops, repeated edges and nulls add nothing. Edges are dealt to tasks, at most
    ``edges_at_once`` to each, which keep the forests of their own. Where that takes
    several tasks, a round follows that keeps one edge between two components, the least.
    """
    pair = edges.where("i is not null and j is not null and w is not null and i != j")
    edge = F.struct("w", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    now = written(pair.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), edge.alias("e")).groupBy("a", "b").agg(F.min("e").alias("e")), "edges")
    forest = None
    while True:
        parts = -(-now.count() // edges_at_once)
        dealt = now.coalesce(1) if parts <= 1 else now.repartition(parts, "a", "b")
        spanned = written(dealt.mapInArrow(_spanned, _EDGE), "spanned")
        drop_written(now)
        now = spanned
        if parts <= 1:
            break
        ends = now.select(F.col("a").alias("c"), "e", "a", "b").union(now.select("b", "e", "a", "b"))
        least = ends.groupBy("c").agg(F.min(F.struct("e", "a", "b")).alias("m"))
        taken = written(least.select("m.e", "m.a", "m.b").distinct(), "taken")
        forest = taken.select("e") if forest is None else forest.union(taken.select("e"))
        named = written(connected_components(taken, "a", "b"), "named")
        moved = now
        for c in ("a", "b"):
            moved = moved.join(named.select(F.col("id").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
        apart = moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "e")
        after = written(apart.groupBy("a", "b").agg(F.min("e").alias("e")), "edges")
        drop_written(now, named)
        now = after
    forest = now.select("e") if forest is None else forest.union(now.select("e"))
    return forest.select("e.i", "e.j", "e.w")


def reachability_forest(points: DataFrame, eps: float, min_points: int, max_points_per_partition: int = POINTS_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """The forest (i, j, w) of squared mutual reachability up to eps, and the squared core
    distances (id, core2) of core points.

    A point's own partition has all its neighbours, and so its core distance; each pair
    of neighbours is in the partitions of both its points.
    """
    partitions = plan_partitions(points.sparkSession, points, eps, max_points_per_partition)
    copies, cost = written(replicate(points, partitions, eps), "copies"), written(costs(points, partitions), "cost")

    def distances(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return kth_distances(group, eps, min_points)

    def forest(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return partition_forest(group, eps)

    core = written(placed(copies, cost).groupBy("task", "pid").applyInPandas(distances, "id long, core2 double"), "core")
    edges = placed(copies.join(core, "id"), cost).groupBy("task", "pid").applyInPandas(forest, "i long, j long, w double")
    return minimum_spanning_forest(edges), core


def forest_components(forest: DataFrame, core: DataFrame, at: float) -> DataFrame:
    """(id, component): core points by a threshold ``at``, and the least core id of their cluster."""
    limit = F.lit(at * at)
    whole = connected_components(forest.where(F.col("w") <= limit), "i", "j")
    return core.where(F.col("core2") <= limit).select("id").join(whole, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
