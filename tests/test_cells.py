"""DBSCAN on cells, and the kernel of a partition, in dense data."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from gridwell.operators import cells
from gridwell.operators.clustering import dbscan_cells
from gridwell.operators.local import local_clusters
from gridwell.sources import in_memory


def brute(x, y, eps, k):
    """For each point: whether it is a core point, and the smallest core ids next to it."""
    d2 = (x[:, None] - x) * (x[:, None] - x) + (y[:, None] - y) * (y[:, None] - y)
    near = d2 <= eps * eps
    core = near.sum(1) >= k
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        reached = np.where(near & core, label, len(x)).min(1)
        new = np.where(core, np.minimum(label, reached), len(x))
        if (new == label).all():
            break
        label = new
    return core, [sorted({int(label[j]) for j in np.flatnonzero(near[i] & core)} if not core[i] else {int(label[i])}) for i in range(len(x))]


def clouds(seed):
    """Uniform, clustered, lattice and repeated points with an eps that suits each."""
    rng = np.random.default_rng(seed)
    yield rng.uniform(-1, 1, (300, 2)), 0.1
    yield rng.uniform(0, 1, (400, 2)), 0.6
    yield np.concatenate([rng.normal(0, 0.02, (200, 2)), rng.normal(0.2, 0.02, (200, 2)), rng.uniform(-1, 1, (40, 2))]), 0.1
    yield np.stack(np.meshgrid(np.arange(18) * 0.1, np.arange(18) * 0.1), -1).reshape(-1, 2), 0.1
    yield np.stack(np.meshgrid(np.arange(18) * 0.25, np.arange(18) * 0.25), -1).reshape(-1, 2), 0.5
    yield np.repeat(rng.uniform(0, 1, (40, 2)), 9, axis=0), 0.12
    # two dense walls whose distance is just eps, just less, and just more
    for gap in (0.5, 0.5 - 1e-12, 0.5 + 1e-12):
        wall = np.stack([np.zeros(150), rng.uniform(0, 0.3, 150)], 1)
        yield np.concatenate([wall, wall + [gap, 0]]), 0.5


@pytest.mark.parametrize("k", [1, 4, 12])
def test_kernel_against_brute_force(k):
    for xy, eps in clouds(k):
        order = np.random.default_rng(1).permutation(len(xy))
        x, y = xy[order].T
        core, near = brute(x, y, eps, k)
        got = local_clusters(pd.DataFrame({"id": np.arange(len(x)), "x": x, "y": y, "home": True}), eps, k)
        assert got["core"].tolist() == core.tolist()
        assert [c.tolist() for c in got["clusters"]] == near


@pytest.mark.parametrize("compared", [256, 1])
def test_spark_form_against_brute_force(spark, monkeypatch, compared):
    """With few points compared at once, boxes are cut finer until single points decide."""
    monkeypatch.setattr(cells, "COMPARED", compared)
    for n, (xy, eps) in enumerate(clouds(7)):
        if n not in ((2, 5) if compared > 1 else (6, 7)):
            continue
        x, y = xy.T
        core, near = brute(x, y, eps, 4)
        names = sorted({c[0] for c in near if c})
        model = dbscan_cells(in_memory(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)]), eps, 4)
        got = {r["id"]: (r["flag"], r["cluster_id"]) for r in model.labeled.collect()}
        assert got == {i: ("CORE" if core[i] else "BORDER" if near[i] else "NOISE", 1 + names.index(near[i][0]) if near[i] else 0) for i in range(len(x))}


def test_many_points_in_one_cell_take_seconds(spark):
    rng = np.random.default_rng(3)
    n = 200_000
    # two dense squares a little more than eps apart, within one cell of 2 eps
    xy = rng.uniform(0, 0.3, (n, 2)) + np.where(rng.random(n) < 0.5, 0.0, 1.4)[:, None] * [1, 0]
    x, y = xy.T
    began = time.process_time()
    got = local_clusters(pd.DataFrame({"id": np.arange(n), "x": x, "y": y, "home": True}), 1.0, 5)
    assert time.process_time() - began < 20
    assert got["core"].all() and len({c[0] for c in got["clusters"]}) == 2
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": x, "y": y})).repartition(8)
    found = dbscan_cells(df, 1.0, 5).labeled.groupBy("flag", "cluster_id").count().collect()
    left = int((x < 1).sum())
    assert sorted(r["count"] for r in found) == sorted([left, n - left]) and {r["flag"] for r in found} == {"CORE"}


def test_sparse_points_around_a_dense_cell():
    """Few points next to many: comparisons stay in proportion."""
    rng = random.Random(5)
    dense = [(rng.uniform(0, 0.5), rng.uniform(0, 0.5)) for _ in range(100_000)]
    ring = [(rng.uniform(-1.5, 2), rng.uniform(-1.5, 2)) for _ in range(60)]
    x, y = np.array(dense + ring).T
    began = time.process_time()
    got = local_clusters(pd.DataFrame({"id": np.arange(len(x)), "x": x, "y": y, "home": True}), 1.0, 5)
    assert time.process_time() - began < 20
    for i in range(100_000, len(x)):
        n = int(((x - x[i]) * (x - x[i]) + (y - y[i]) * (y - y[i]) <= 1.0).sum())
        assert got["core"][i] == (n >= 5)


def test_plan_has_no_loops_and_no_single_task(spark):
    rng = random.Random(6)
    df = in_memory(spark, [(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(200)])
    plan = dbscan_cells(df, 0.1, 4).labeled._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan
