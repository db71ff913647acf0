"""Connected components of an edge DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwell.operators.local import least_labels
from gridwell.session import drop_written, written

#: Edges that one task contracts at once.
EDGES_AT_ONCE = 1 << 20

_EDGE = "u long, v long"


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", edges_at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """``(id, component)`` for every vertex that has an edge, written.

    ``component`` is the smallest id that can be reached. Self-loops, repeated
    edges and nulls add nothing; ids are longs. Edges are dealt to tasks, at most
    ``edges_at_once`` to each, and each task contracts its own to stars. Where that
    takes several tasks, a large-star and a small-star step follow, and all is repeated
    until the edge set is a set of stars. The steps take minima map-side and join
    them back on the vertex from written tables, so that adaptive execution can split
    the edges of a hot vertex; no adjacency list is ever built.
    """
    pairs = edges.select(F.col(src).cast("long").alias("s"), F.col(dst).cast("long").alias("d")).where("s is not null and d is not null and s != d")
    now = written(pairs.select(F.greatest("s", "d").alias("u"), F.least("s", "d").alias("v")).distinct(), "edges")
    while True:
        parts = -(-now.count() // edges_at_once)
        if parts > 1 and _settled(now):
            break
        dealt = now.coalesce(1) if parts <= 1 else now.repartition(parts, "u", "v")
        contracted = written(dealt.mapInArrow(_stars, _EDGE), "edges")
        drop_written(now)
        now = contracted
        if parts <= 1:
            break
        now = _step(_step(now, _large_star), _small_star)
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def with_edges(components: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of a graph whose ``components`` are known and to which ``edges`` are added.

    New edges are contracted to edges between old components, of which only those that
    meet are labelled anew. Vertices that were unknown come in with their edges.
    """
    pairs = edges.select(F.col(src).cast("long").alias("s"), F.col(dst).cast("long").alias("d")).where("s is not null and d is not null and s != d")
    old = components.select("id", "component")
    ends = written(pairs.select(F.col("s").alias("id")).union(pairs.select("d")).distinct().join(old, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.isnull("component").alias("new")), "ends")
    named = pairs
    for c in ("s", "d"):
        named = named.join(ends.select(F.col("id").alias(c), "component"), c).withColumn(c, F.col("component")).drop("component")
    moved = written(connected_components(named, "s", "d").select(F.col("id").alias("component"), F.col("component").alias("now")), "moved")
    known = old.union(ends.where("new").select("id", "component"))
    return known.join(moved, "component", "left").select("id", F.coalesce("now", "component").alias("component"))


def reachable(edges: DataFrame, starts: DataFrame, src: str = "src", dst: str = "dst", steps: int = 12) -> DataFrame:
    """(id) of all vertices that ``starts`` (id) reach over undirected ``edges``, themselves included.

    Each step goes one edge on from what the last one found, and from nothing else, so
    edges elsewhere are not followed. What is still going after ``steps`` is deep: then
    the rest, without what has been left behind, is contracted to components.
    """
    both = edges.select(F.col(src).cast("long").alias("s"), F.col(dst).cast("long").alias("d")).where("s is not null and d is not null and s != d")
    both = both.union(both.select("d", "s"))
    found = front = written(starts.select(F.col("id").cast("long").alias("id")).distinct(), "front")
    for _ in range(steps):
        front = written(both.join(front, both["s"] == front["id"], "left_semi").select(F.col("d").alias("id")).distinct().join(found, "id", "left_anti"), "front")
        if front.isEmpty():
            return found
        found = found.union(front)
    behind = found.join(front, "id", "left_anti")
    rest = both.join(behind.withColumnRenamed("id", "s"), "s", "left_anti").join(behind.withColumnRenamed("id", "d"), "d", "left_anti")
    whole = written(connected_components(rest, "s", "d"), "whole")
    met = whole.join(front, "id", "left_semi").select("component").distinct()
    return found.union(whole.join(met, "component", "left_semi").select("id").join(found, "id", "left_anti"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a task's edges, each as a star around its smallest vertex."""
    held = [b.to_pandas().to_numpy(np.int64) for b in batches if b.num_rows]
    if not held:
        return
    ids, index = np.unique(np.concatenate(held), return_inverse=True)
    i, j = index.reshape(-1, 2).T
    label = least_labels(len(ids), np.concatenate([i, j]), np.concatenate([j, i]))
    own = np.flatnonzero(label != np.arange(len(ids)))
    for at in range(0, len(own), 1 << 16):
        some = own[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label[some]])], ["u", "v"])


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no vertex has two smaller neighbours, or smaller and larger ones."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _step(edges: DataFrame, star) -> DataFrame:
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m"), "least")
    after = written(star(edges, least).distinct(), "edges")
    drop_written(least)
    drop_written(edges)
    return after


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest of its neighbourhood."""
    return edges.join(least, edges["v"] == least["x"], "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them."""
    moved = edges.join(least, edges["u"] == least["x"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
