"""Planning below cells, salted range joins, rectangle tables and growing graphs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridwell.operators import neighbors
from gridwell.operators.clustering import dbscan
from gridwell.operators.components import connected_components, reachable, with_edges
from gridwell.operators.partitioner import plan_partitions, replicate
from gridwell.operators.rectangles import points_in, rectangles_in
from gridwell.sources import in_memory
from tests.test_clustering import brute, labels


def crowded(seed):
    """A cell of many points, some of them in one place, among others."""
    rng = random.Random(seed)
    points = [(i, rng.uniform(0.02, 0.58), rng.uniform(0.02, 0.58)) for i in range(150)]
    points += [(1000 + i, -0.3, -0.3) for i in range(30)]
    return points + [(2000 + i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(120)]


def test_leaves_of_full_cells(spark):
    points, eps, most = crowded(1), 0.3, 20
    df = in_memory(spark, points)
    found = plan_partitions(spark, df, eps, most, halvings=12)
    leaves = found.leaves.collect()
    assert sum(r["n"] for r in leaves) + sum(r["n"] for r in found.boxes.collect()) == len(points)
    # only the points of one place are more than a leaf should hold
    assert [r["n"] for r in leaves if r["n"] > most] == [30]
    copies = {}
    for r in replicate(df, found, eps).collect():
        copies.setdefault(r["pid"], {})[r["id"]] = r["home"]
    homes = {}
    for pid, own in copies.items():
        for i, home in own.items():
            if home:
                assert i not in homes
                homes[i] = pid
    assert set(homes) == {i for i, _, _ in points}
    for r in leaves:
        side = 2 * eps / (1 << r["depth"])
        x, y = r["lx"] * side, r["ly"] * side
        want = {i: math.floor(px / side) == r["lx"] and math.floor(py / side) == r["ly"] for i, px, py in points if x - eps <= px <= x + side + eps and y - eps <= py <= y + side + eps}
        assert copies[r["pid"]] == want and sum(want.values()) == r["n"]


@pytest.mark.parametrize("halvings", [1, 12])
def test_clusters_with_cut_cells(spark, halvings):
    points = crowded(2)
    for eps, k in ((0.3, 6), (0.05, 4)):
        assert labels(dbscan(in_memory(spark, points), eps, k, 15, halvings=halvings)) == brute(points, eps, k)


def test_heavy_cells_are_dealt_evenly(spark):
    """10^5 points of one cell: no part of the join has twice the median of its left side."""
    df = spark.range(100_000).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    one, every = neighbors._salted(*neighbors._sides(df, df.limit(50), 2.0), 200)
    keys = ["cx", "cy", "salt"]
    sizes = sorted(r["count"] for r in one.groupBy(*keys).count().collect())
    assert sum(sizes) == 100_000 and len(sizes) == 500 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    tasks = sorted(r["count"] for r in one.repartition(8, *keys).groupBy(F.spark_partition_id()).count().collect())
    assert len(tasks) == 8 and tasks[-1] <= 2 * tasks[4]
    own = every.join(one.select(*keys).distinct(), keys, "left_semi").groupBy("j").count().collect()
    assert {r["count"] for r in own} == {500}


def test_salted_pairs_are_the_same(spark):
    df = in_memory(spark, crowded(3))
    pairs = lambda heavy: sorted(map(tuple, neighbors.neighbor_pairs(df, df, 0.2, heavy).collect()))
    assert pairs(7) == pairs(None)


def test_rectangles_of_many_sizes(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(300)] + [(500, 1.0, 2.0), (501, -1.0, 0.0)]
    rects = []
    for pid in range(60):
        x, y, w = rng.uniform(-9, 9), rng.uniform(-9, 9), 10 ** rng.uniform(-3, 1.2)
        rects.append((pid, x, y, x + w * rng.random(), y + w))
    rects += [(100, 1.0, 2.0, 1.0, 2.0), (101, -1.0, 0.0, 1.0, 2.0), (102, 5.0, 5.0, 4.0, 6.0), (103, -1e6, -1e6, 1e6, 1e6)]
    df = in_memory(spark, points)
    table = spark.createDataFrame(rects + [(104, None, 0.0, 1.0, 1.0)], "pid int, x double, y double, x2 double, y2 double")
    for closed in (True, False):
        found = points_in(df, table, closed)
        got = sorted((r["pid"], r["id"]) for r in found.collect())
        inside = lambda p, r: (r[1] <= p[1] <= r[3] and r[2] <= p[2] <= r[4]) if closed else (r[1] < p[1] < r[3] and r[2] < p[2] < r[4])  # noqa: B023, E731
        assert got == sorted((r[0], p[0]) for r in rects for p in points if inside(p, r))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r["outer_pid"], r["inner_pid"]) for r in rectangles_in(table, table).collect())
    assert got == sorted((a[0], b[0]) for a in rects if a[0] != 102 for b in rects if a[1] <= b[1] and a[2] <= b[2] and a[3] >= b[3] and a[4] >= b[4])
    assert points_in(df, table.limit(0)).collect() == []


def test_reachable(spark):
    """A chain of 2,000, a hub, another component, odd rows, and starts without edges."""
    edges = [(i, i + 1) for i in range(2000)] + [(5000, 6000 + i) for i in range(300)] + [(9000, 9001), (None, 3), (7, 7)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(4)
    starts = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    run = lambda *ids: sorted(r["id"] for r in reachable(df, starts(*ids)).collect())
    assert run(1000) == list(range(2001))
    assert run(6005, 9001) == [5000, *range(6000, 6300), 9000, 9001]
    assert run(12345) == [12345]


def test_reachable_follows_no_other_edges(spark):
    """A short component is found by its own steps: nothing is contracted."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 4000, 2)] + [(2, 5000), (5000, 5001)], "src long, dst long")
    got = reachable(edges, spark.createDataFrame([(5001,)], "id long"))
    assert sorted(r["id"] for r in got.collect()) == [2, 3, 5000, 5001]
    read = sum(int(f.split("front-")[1] != "") for f in got.inputFiles() if "front-" in f)
    assert read and all("whole-" not in f for f in got.inputFiles())


def test_added_edges(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(160)]
    lots = [spark.createDataFrame(edges[a:b] + [(None, 1), (3, 3)], "src long, dst long") for a, b in ((0, 90), (90, 130), (130, 160))]
    found = connected_components(lots[0])
    for lot in lots[1:]:
        found = with_edges(found, lot)
    want = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
