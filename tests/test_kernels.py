"""What one partition does: the tree of points, the indexed heap, forests; and where partitions go."""

import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from gridwell.operators import local
from gridwell.operators.clustering import local_labels
from gridwell.operators.forest import minimum_spanning_forest, reachability_forest
from gridwell.operators.partitioner import costs, dealt, placed, plan_partitions, replicate
from gridwell.sources import in_memory
from tests.test_nearest import kruskal

rng = np.random.default_rng(8)
CLOUDS = {
    "one": (np.array([3.0]), np.array([4.0])),
    "same": (np.full(200, 1.5), np.full(200, -2.0)),
    "lattice": (np.repeat(np.arange(20), 20) * 0.5, np.tile(np.arange(20), 20) * 0.5),
    "line": (np.arange(300) * 0.1, np.zeros(300)),
    "mixed": (np.concatenate([rng.normal(0, 1, 300), rng.normal(2, 0.001, 200)]), np.concatenate([rng.normal(0, 1, 300), rng.normal(2, 0.001, 200)])),
}


def distances(x, y):
    return (x[:, None] - x) * (x[:, None] - x) + (y[:, None] - y) * (y[:, None] - y)


@pytest.mark.parametrize("name", CLOUDS)
@pytest.mark.parametrize("eps", [0.5, 2.0])
def test_tree_against_all_pairs(name, eps):
    x, y = CLOUDS[name]
    d2 = distances(x, y)
    for k in (1, 5, 40):
        want = np.sort(d2, axis=1)[:, k - 1] if len(x) >= k else np.full(len(x), np.inf)
        assert np.array_equal(local._Tree(x, y, eps).kth(k), np.where(want <= eps * eps, want, np.inf))


def test_tree_in_a_crowd_is_faster_than_cells():
    """30,000 points of one cell and lone ones around: the tree asks for all, cells for a hundredth."""
    x, y = np.concatenate([rng.normal(0, 1e-3, (30_000, 2)), rng.random((3_000, 2)) * 20]).T
    began = time.perf_counter()
    found = local._Tree(x, y, 0.6).kth(5)
    took = time.perf_counter() - began
    near, asked = local._Near(x, y, 0.6), range(0, len(x), 100)
    began = time.perf_counter()
    for p in asked:
        d2 = near(p)[1]
        assert found[p] == (np.partition(d2, 4)[4] if len(d2) >= 5 else np.inf)
    # at least twice as fast
    assert 2 * took < 100 * (time.perf_counter() - began)


def test_heap_holds_each_number_once():
    heap, keys = local._Heap(300), {}
    rng = random.Random(3)
    for _ in range(6000):
        if keys and rng.random() < 0.2:
            want = min(keys, key=lambda p: (keys[p], p))
            assert heap.pop() == want
            del keys[want]
        else:
            p, key = rng.randrange(300), float(rng.randrange(50))
            if key < keys.get(p, np.inf):
                keys[p] = key
                heap.lower(key, p)
        assert len(heap) == len(keys)
    while keys:
        want = min(keys, key=lambda p: (keys[p], p))
        assert heap.pop() == want
        del keys[want]


@pytest.mark.parametrize("at_once", [30, 1 << 21])
def test_forest_by_blocks_against_kruskal(monkeypatch, at_once):
    monkeypatch.setattr(local, "_EDGES_AT_ONCE", at_once)
    rng = random.Random(11)
    edges = [(rng.randrange(80), rng.randrange(80), float(rng.randrange(6))) for _ in range(700)] + [(100 + i, 101 + i, 1.0) for i in range(99)]
    forest = local._Forest(200)
    for at in range(0, len(edges), 25):
        a, b, w = (np.array(c) for c in zip(*((min(i, j), max(i, j), w) for i, j, w in edges[at : at + 25] if i != j), strict=True))
        forest.add(w, a, b)
    w, a, b = forest.settle()
    assert set(zip(a.tolist(), b.tolist(), w.tolist(), strict=True)) == kruskal(edges)


@pytest.mark.parametrize("name", [*CLOUDS, "crowds", "copies"])
def test_partition_forest_against_kruskal(name):
    own = np.random.default_rng(9)
    crowds = np.concatenate([own.normal(0, 1e-4, (150, 2)), own.normal(0.02, 1e-4, (150, 2)), own.random((30, 2)) * 0.1])
    copies = np.repeat(own.integers(0, 9, (60, 2)) * 0.1, own.integers(1, 12, 60), axis=0)
    x, y = CLOUDS[name] if name in CLOUDS else {"crowds": crowds, "copies": copies}[name].T
    for eps in (0.05, 0.5):
        group = pd.DataFrame({"id": 3 * own.permutation(len(x)), "x": x, "y": y, "home": True})
        group = group.merge(local.kth_distances(group, eps, 5), on="id")
        if group.empty:
            continue
        i, v, w, c = (group[n].to_numpy() for n in ("id", "x", "y", "core2"))
        d2 = distances(v, w)
        weight = np.maximum(np.maximum(c[:, None], c), d2)
        a, b = np.nonzero((d2 <= eps * eps) & (i[:, None] < i))
        want = kruskal(list(zip(i[a].tolist(), i[b].tolist(), weight[a, b].tolist(), strict=True)))
        assert {tuple(r) for r in local.partition_forest(group, eps).itertuples(index=False)} == want
        group["home"] = group["x"] > group["x"].median()
        home = set(group["id"][group["home"]])
        assert {tuple(r) for r in local.partition_forest(group, eps).itertuples(index=False)} == {e for e in want if home & {*e[:2]}}


def test_forest_of_a_crowd_holds_points_not_pairs():
    """5,000 points within eps of each other: 25 million pairs."""
    x, y = np.random.default_rng(3).normal(0, 0.005, (2, 5_000))
    group = pd.DataFrame({"id": np.arange(len(x)), "x": x, "y": y, "home": True})
    tracemalloc.start()
    try:
        forest = local.partition_forest(group.merge(local.kth_distances(group, 0.05, 5), on="id"), 0.05)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(forest) == len(x) - 1 and most < 32e6


def test_tree_leaves_copies_of_one_place_alone(monkeypatch):
    """20,000 copies of a point: no leaf looks beyond itself."""
    asked = []
    held = local._Tree._held
    monkeypatch.setattr(local._Tree, "_held", lambda self, leaves: asked.append(len(leaves)) or held(self, leaves))
    assert not local._Tree(np.full(20_000, 1.0), np.full(20_000, 2.0), 0.5).kth(5).any() and not asked


def test_forest_of_many_tasks_against_kruskal(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(90), rng.randrange(90), float(rng.randrange(5))) for _ in range(600)]
    df = spark.createDataFrame(edges, "i long, j long, w double")
    assert {tuple(r) for r in minimum_spanning_forest(df, 40).collect()} == kruskal(edges)


@pytest.mark.parametrize("most", [40, 5000])
def test_forest_over_partitions_is_that_of_all_pairs(spark, most):
    x, y = CLOUDS["mixed"]
    x, y = np.concatenate([x, np.repeat(np.arange(8), 8) * 0.5 + 10]), np.concatenate([y, np.tile(np.arange(8), 8) * 0.5])
    eps, k = 0.5, 5
    d2 = distances(x, y)
    far = np.sort(d2, axis=1)[:, k - 1]
    core = {i: f for i, f in enumerate(far.tolist()) if f <= eps * eps}
    edges = [(i, j, max(d2[i, j], core[i], core[j])) for i in core for j in core if i < j and d2[i, j] <= eps * eps]
    forest, found = reachability_forest(in_memory(spark, list(zip(range(len(x)), x.tolist(), y.tolist(), strict=True))), eps, k, most)
    assert {r["id"]: r["core2"] for r in found.collect()} == core
    assert {tuple(r) for r in forest.collect()} == kruskal(edges)


def test_forest_of_none(spark):
    forest, core = reachability_forest(in_memory(spark, []), 0.5, 3)
    assert forest.collect() == [] and core.collect() == []
    forest, core = reachability_forest(in_memory(spark, [(1, 0.0, 0.0), (2, 9.0, 9.0)]), 0.5, 2)
    assert forest.collect() == [] and core.collect() == []


def test_partitions_are_dealt_by_cost(spark):
    """Few heavy partitions and many light ones: no task has over 1.3 times the mean, kernels stay in place."""
    rng = random.Random(2)
    pts = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(4000)] + [(9000 + i, 5 + rng.random(), 5 + rng.random()) for i in range(1000)]
    df = in_memory(spark, pts)
    partitions = plan_partitions(spark, df, 0.05, 60)
    cost = {r["pid"]: r["cost"] for r in costs(df, partitions).collect()}
    cells = {}
    for _, x, y in pts:
        at = np.floor(x / 0.1), np.floor(y / 0.1)
        cells[at] = cells.get(at, 0) + 1
    assert sum(cost.values()) == sum(n * n for n in cells.values())
    copies = replicate(df, partitions, 0.05)
    for most in (1 << 16, 10):
        put = placed(copies, costs(df, partitions), 4, most)
        assert put.rdd.getNumPartitions() == 4
        rows = put.select("task", "pid", "id").collect()
        task = {r["pid"]: r["task"] for r in rows}
        assert {(r["task"], r["pid"]) for r in rows} == {(t, p) for p, t in task.items()} and len(rows) == copies.count()
    loads = [0] * 4
    for pid, t in dealt(list(cost.items()), 4).items():
        loads[t] += cost[pid]
    assert max(loads) < 1.3 * sum(loads) / 4
    plan = local_labels(put, 0.05, 4)._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("FlatMapGroupsInPandas") :].partition("Exchange")[2].partition("\n")[0]
    assert "REPARTITION_BY_NUM" in above and "task" in above
    plain = {(r["pid"], r["id"], r["core"], tuple(r["clusters"])) for r in local_labels(copies, 0.05, 4).collect()}
    assert {(r["pid"], r["id"], r["core"], tuple(r["clusters"])) for r in local_labels(put, 0.05, 4).collect()} == plain
