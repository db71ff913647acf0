"""DBSCAN and OPTICS over DataFrames of points (id, x, y).

Ids are distinct. Every input row is in the output once; noise has cluster 0, and
clusters are numbered 1..k by the smallest id of their core points. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwell.functions import flag
from gridwell.operators.cells import cell_clusters, cell_graph, cell_links
from gridwell.operators.components import connected_components
from gridwell.operators.forest import forest_components, reachability_forest
from gridwell.operators.local import local_clusters, optics_order
from gridwell.operators.nearest import k_nearest
from gridwell.operators.partitioner import Partitions, costs, cut_copies, placed, plan_partitions, replicate
from gridwell.session import written


@dataclass(frozen=True)
class ClusterModel:
    """Parameters, partitions and labelled points (id, flag, cluster_id) of a run."""

    eps: float
    min_points: int
    labeled: DataFrame
    partitions: DataFrame | None = None
    points: DataFrame | None = None

    def predict(self, queries: DataFrame, points: DataFrame) -> DataFrame:
        """(id, cluster_id): the cluster of the nearest core point within eps, else 0."""
        cores = points.join(self.labeled.where("flag = 'CORE'").select("id"), "id", "left_semi")
        near = k_nearest(written(cores.select("id", "x", "y"), "cores"), self.eps, 1, queries).select("id", "neighbor")
        named = near.join(self.labeled.select(F.col("id").alias("neighbor"), "cluster_id"), "neighbor").select("id", "cluster_id")
        return queries.select("id").join(named, "id", "left").fillna(0, ["cluster_id"])


def _labeled(ids: DataFrame, core: DataFrame, component: DataFrame) -> DataFrame:
    """Flags and numbered clusters from core ids and components (id, component)."""
    numbered = _numbered(component.select("component").distinct())
    joined = ids.join(component, "id", "left").join(numbered, "component", "left").join(core.withColumn("core", F.lit(True)), "id", "left")
    cluster = F.coalesce("cluster_id", F.lit(0).cast("long"))
    return joined.select("id", flag(F.coalesce("core", F.lit(False)), cluster).alias("flag"), cluster.alias("cluster_id"))


def _numbered(names: DataFrame) -> DataFrame:
    """(component, cluster_id): numbers from 1 in the order of the names, counted by ranges."""
    ranged = written(names.repartitionByRange("component").withColumn("range", F.spark_partition_id()), "names")
    counts = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}
    before, rows = 0, []
    for part in sorted(counts):
        rows.append((part, before))
        before += counts[part]
    # one row for each range
    offsets = F.broadcast(ranged.sparkSession.createDataFrame(rows, "range int, before long"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("component"))
    return ranged.withColumn("own", own).join(offsets, "range").select("component", (F.col("own") + F.col("before")).cast("long").alias("cluster_id"))


def dbscan_declarative(points: DataFrame, eps: float, min_points: int) -> ClusterModel:
    """DBSCAN as joins and aggregates alone. A point has as many rows as its nearest that
    count, ``min_points`` at most: those tell core points, and they are all the neighbours
    of any other. Core points are linked by :func:`~gridwell.operators.cells.cell_links`."""
    nearest = written(k_nearest(points, eps, max(min_points, 1)).select("id", "rank", "neighbor"), "nearest")
    core = written(nearest.where(F.col("rank") == max(min_points, 1)).select("id"), "core")
    edges = cell_links(written(points.select("id", "x", "y").join(core, "id", "left_semi"), "points"), eps)
    found = core.join(connected_components(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    found = written(found, "components")
    rim = nearest.join(core, "id", "left_anti").join(found.withColumnRenamed("id", "neighbor"), "neighbor")
    border = rim.groupBy("id").agg(F.min("component").alias("component"))
    return ClusterModel(eps, min_points, _labeled(points.select("id"), core, found.union(border)))


def dbscan_cells(points: DataFrame, eps: float, min_points: int) -> ClusterModel:
    """DBSCAN on the graph of cells eps / sqrt(2) wide: rows in proportion to the points,
    however many a cell holds; nothing is planned and no group is held by one task."""
    core, component = cell_graph(points, eps, min_points)
    return ClusterModel(eps, min_points, _labeled(points.select("id"), core, component), points=points)


def dbscan(points: DataFrame, eps: float, min_points: int, max_points_per_partition: int = 50_000, merge: str = "core", halvings: int = 0) -> ClusterModel:
    """DBSCAN by partitions of bounded size, clustered apart and merged.

    Points are copied to every partition within eps. A core point's own partition sees
    all its neighbours, so the local clusters of all its copies are one cluster
    (``merge="core"``); ``merge="any_shared"`` also joins clusters that share a border
    point. Border points join the cluster of the smallest name next to any copy. With
    ``halvings`` cells of too many points are cut (see :func:`plan_partitions`): those
    cells and what lies within eps of them are one more partition, that no task holds
    (:func:`_cut_labels`).
    """
    partitions = plan_partitions(points.sparkSession, points, eps, max_points_per_partition, halvings=halvings)
    whole_cells = Partitions(partitions.boxes, partitions.cells, partitions.side)
    copies = placed(replicate(points, whole_cells, eps), costs(points, whole_cells))
    local = written(local_labels(copies, eps, min_points), "local")
    if partitions.leaves is not None and not partitions.leaves.isEmpty():
        local = written(local.union(_cut_labels(points, partitions, eps, min_points)), "local")
    known = written(copies_merged(local), "known")
    whole = global_cluster_map(local, cluster_adjacencies(known, merge))
    return ClusterModel(eps, min_points, relabel_union(points.select("id"), known, whole), partitions.boxes, points)


def _cut_labels(points: DataFrame, partitions: Partitions, eps: float, min_points: int) -> DataFrame:
    """What :func:`local_labels` gives, for the cut cells as one partition (pid -1), by the
    graph of cells: copies to leaves would grow with the square of what a cell holds."""
    copies = written(cut_copies(points, partitions, eps), "copies")
    core, inside, next_to = cell_clusters(copies, eps, min_points)
    named = inside.union(next_to).groupBy("id").agg(F.collect_set("component").alias("clusters"))
    known = copies.select("id", "home").join(core.withColumn("core", F.lit(True)), "id", "left").join(named, "id", "left")
    none = F.array().cast("array<long>")
    return known.select(F.lit(-1).alias("pid"), "id", "home", F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("clusters", none).alias("clusters"))


def local_labels(copies: DataFrame, eps: float, min_points: int) -> DataFrame:
    """Clusters of each partition's copies apart: pid, id, home, core (here), and the names
    of the local clusters that a copy is in or next to. A local cluster has the name of
    its smallest core point. Copies that were placed stay in their tasks."""

    def kernel(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return local_clusters(group, eps, min_points).assign(pid=key[-1])

    keys = [c for c in ("task", "pid") if c in copies.columns]
    return copies.groupBy(*keys).applyInPandas(kernel, "pid int, id long, home boolean, core boolean, clusters array<long>")


def local_cluster_ids(local: DataFrame) -> DataFrame:
    """(pid, cluster): the local clusters of each partition."""
    return local.where("core").select("pid", F.explode("clusters").alias("cluster")).distinct()


def copies_merged(local: DataFrame) -> DataFrame:
    """(id, core, clusters): whether a point is a core point at home, and all copies' clusters.
    A point has a copy in four partitions at most, and in each leaf of a cut cell within eps."""
    return local.groupBy("id").agg(F.max(F.col("home") & F.col("core")).alias("core"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("clusters")))).alias("clusters"))


def cluster_adjacencies(known: DataFrame, merge: str = "core") -> DataFrame:
    """(src, dst): local clusters that are one because they share a core point, or with
    ``merge="any_shared"`` any point; src is the smallest of those that share it."""
    shared = known if merge == "any_shared" else known.where("core")
    pairs = shared.where(F.size("clusters") > 1).select(F.array_min("clusters").alias("src"), F.explode("clusters").alias("dst"))
    return pairs.where("src != dst").distinct()


def global_cluster_map(local: DataFrame, adjacencies: DataFrame) -> DataFrame:
    """(cluster, component): the smallest name that each local cluster's is linked to."""
    whole = connected_components(adjacencies).withColumnRenamed("id", "cluster")
    names = local_cluster_ids(local).select("cluster").distinct()
    return names.join(whole, "cluster", "left").select("cluster", F.coalesce("component", "cluster").alias("component"))


def relabel_union(ids: DataFrame, known: DataFrame, whole: DataFrame) -> DataFrame:
    """(id, flag, cluster_id): every point once, with the smallest of its clusters' components."""
    named = known.select("id", F.explode("clusters").alias("cluster")).join(whole, "cluster")
    return _labeled(ids, known.where("core").select("id"), named.groupBy("id").agg(F.min("component").alias("component")))


def optics(points: DataFrame, eps: float, min_points: int, max_points_per_partition: int | None = None) -> DataFrame:
    """(pid, id, pos, reach, core_dist, gap): the OPTICS order.

    ``gap`` is the distance to the previous point of the order. Without a partition size
    there is one order over all points, which one task makes: OPTICS is sequential. With
    one, each partition has its own order, made with copies of all points within eps of
    it, of which only its own points are kept: core distances are those of the whole, and
    reachabilities and gaps may be from a copy. :func:`optics_clusters` merges the
    clusters of such orders.
    """
    if max_points_per_partition is None:
        return _ordered(points.select(F.lit(0).alias("pid"), "id", "x", "y", F.lit(True).alias("home")), eps, min_points).drop("home")
    own = _grown_order(points, eps, min_points, max_points_per_partition).where("home").drop("home")
    place = F.row_number().over(Window.partitionBy("pid").orderBy("pos")).cast("long") - 1
    return own.select("pid", "id", place.alias("pos"), "reach", "core_dist", "gap")


def _grown_order(points: DataFrame, eps: float, min_points: int, max_points_per_partition: int) -> DataFrame:
    """The order of each partition and the copies of all points within eps of it."""
    partitions = plan_partitions(points.sparkSession, points, eps, max_points_per_partition)
    return _ordered(replicate(points, partitions, eps), eps, min_points)


def _ordered(copies: DataFrame, eps: float, min_points: int) -> DataFrame:
    def kernel(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = optics_order(group, eps, min_points)
        return found.assign(pid=key[0], home=group.sort_values("id")["home"].to_numpy())

    schema = "pid int, id long, pos long, reach double, core_dist double, x double, y double, home boolean"
    ordered = copies.groupBy("pid").applyInPandas(kernel, schema)
    ordered = ordered.select("pid", "id", "pos", "x", "y", "home", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("reach", "core_dist")))
    w = Window.partitionBy("pid").orderBy("pos")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    return ordered.withColumn("gap", F.sqrt(dx * dx + dy * dy)).drop("x", "y")


def optics_clusters(points: DataFrame, eps: float, min_points: int, max_points_per_partition: int, ratio: float | None = None, at: float | None = None) -> DataFrame:
    """(id, flag, cluster_id): clusters of the partitions' orders, merged.

    They are cut by ``ratio`` if it is given, else by the threshold ``at`` (eps). All
    copies of a core point (by the threshold, if that cuts) are in one cluster; of its
    copies' clusters any other point is in the one of the smallest name. By the threshold
    the clusters of core points are those of the global order.
    """
    ordered = written(_grown_order(points, eps, min_points, max_points_per_partition), "order")
    at = eps if at is None else at
    cut = eps_clusters(ordered, at) if ratio is None else ratio_clusters(ordered, ratio)
    core = F.col("core_dist").isNotNull() if ratio is not None else F.coalesce(F.col("core_dist") <= F.lit(float(at)), F.lit(False))
    placed = cut.select("pid", "id", "cluster_id").join(ordered.select("pid", "id", "home", core.alias("core")), ["pid", "id"])
    name = F.when(F.col("cluster_id") != 0, F.shiftleft(F.col("pid").cast("long"), 32) + F.col("cluster_id"))
    known = written(placed.groupBy("id").agg(F.max(F.col("home") & F.col("core")).alias("core"), F.collect_set(name).alias("clusters")), "known")
    edges = known.where("core and size(clusters) > 1").select(F.array_min("clusters").alias("src"), F.explode("clusters").alias("dst"))
    whole = connected_components(edges).withColumnRenamed("id", "name")
    named = known.select("id", "core", F.explode("clusters").alias("name")).join(whole, "name", "left")
    found = written(named.groupBy("id", "core").agg(F.min(F.coalesce("component", "name")).alias("component")), "components")
    # a ratio can cut off points of which none is a core point
    first = F.coalesce(F.min(F.when(F.col("core"), F.col("id"))), F.min("id"))
    least = found.groupBy("component").agg(first.alias("first"))
    return _labeled(points.select("id"), known.where("core").select("id"), found.join(least, "component").select("id", F.col("first").alias("component")))


def forest_cuts(points: DataFrame, eps: float, min_points: int, at: list[float]) -> DataFrame:
    """(cut, id, cluster_id): clusters of core points at each of the thresholds ``at``, up to
    eps, from one forest; cuts are numbered from 0 in the order that they are given in."""
    forest, core = reachability_forest(points, eps, min_points)
    forest = written(forest, "forest")
    cuts = []
    for n, limit in enumerate(at):
        found = written(forest_components(forest, core, limit), "components")
        numbered = _numbered(found.select("component").distinct())
        cuts.append(found.join(numbered, "component").select(F.lit(n).alias("cut"), "id", "cluster_id"))
    out = cuts[0]
    for other in cuts[1:]:
        out = out.union(other)
    return out


def _cut(ordered: DataFrame, noise, cut) -> DataFrame:
    w = Window.partitionBy("pid").orderBy("pos")
    marked = ordered.withColumn("noise", noise).withColumn("step", F.coalesce(F.when(~F.col("noise"), cut(w).cast("int")), F.lit(0)))
    number = F.when(F.col("noise"), 0).otherwise(F.sum("step").over(w)).cast("long")
    kind = F.when(F.col("core_dist").isNotNull(), "CORE").when(F.col("reach").isNotNull(), "BORDER").otherwise("NOISE")
    return marked.select("pid", "id", "pos", kind.alias("flag"), number.alias("cluster_id"))


def ratio_clusters(ordered: DataFrame, ratio: float = 0.4) -> DataFrame:
    """Clusters where reachability jumps: a new one after noise, and where the previous
    value over the present one is below ``ratio``. A core point without reachability
    counts with its gap; the first point of an order has neither and makes no second cut."""
    ordered = ordered.withColumn("value", F.coalesce("reach", "gap"))

    def cut(w):
        before = F.lag("value").over(w)
        return F.coalesce(F.lag("noise").over(w), F.lit(True)) | F.coalesce((F.col("value") > 0) & (before < F.lit(float(ratio)) * F.col("value")), F.lit(False))

    return _cut(ordered, F.col("reach").isNull() & F.col("core_dist").isNull(), cut)


def eps_clusters(ordered: DataFrame, eps: float) -> DataFrame:
    """Clusters by a threshold: beyond it a core point starts one, any other is noise."""
    far = F.coalesce(F.col("reach") > F.lit(float(eps)), F.lit(True))
    core = F.coalesce(F.col("core_dist") <= F.lit(float(eps)), F.lit(False))
    return _cut(ordered, far & ~core, lambda w: far)


def contingency(labeled: DataFrame) -> DataFrame:
    """(cluster_id, label, n) of points with both."""
    return labeled.groupBy("cluster_id", "label").agg(F.count("*").alias("n"))


def label_mapping(labeled: DataFrame) -> DataFrame:
    """(cluster_id, label): the most frequent label of each cluster, ties to the smaller."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "label")
    return contingency(labeled).where("cluster_id != 0").withColumn("k", F.row_number().over(w)).where("k = 1").select("cluster_id", "label")


def accuracy(labeled: DataFrame, noise_label: int = 0) -> DataFrame:
    """One row (n, n_right): points whose cluster's label is their own."""
    told = label_mapping(labeled).withColumnRenamed("label", "told")
    right = F.coalesce("told", F.lit(noise_label)) == F.col("label")
    return labeled.join(told, "cluster_id", "left").agg(F.count("*").alias("n"), F.coalesce(F.sum(right.cast("long")), F.lit(0)).alias("n_right"))
