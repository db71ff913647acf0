"""Steps that must not make a row for each pair of points within eps, however dense they are."""

import numpy as np
import pytest
from test_clustering import brute, labels

from gridwell.operators import clustering as C
from gridwell.operators import neighbors
from gridwell.operators.cells import cell_links
from gridwell.operators.components import connected_components
from gridwell.operators.nearest import core_distances, k_nearest
from gridwell.operators.partitioner import leaf_copies, plan_partitions
from gridwell.sources import in_memory


def dense(n, seed=5, scale=0.02):
    """A crowd, twenty points in one place and some that are far from it."""
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.normal(0.31, scale, (n, 2)), np.full((20, 2), 0.3), rng.uniform(-1, 1, (40, 2))])
    return [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]


@pytest.fixture
def no_pairs(monkeypatch):
    def fail(*args, **kwargs):
        raise AssertionError("all pairs within eps")

    for module in (neighbors, C):
        monkeypatch.setattr(module, "neighbor_pairs", fail, raising=False)


def near(asked, points, eps, k):
    out = {}
    for i, x, y in asked:
        found = sorted(((x - u) * (x - u) + (y - v) * (y - v), j) for j, u, v in points)
        out[i] = [j for d2, j in found if d2 <= eps * eps][:k]
    return {i: js for i, js in out.items() if js}


def by_rank(found):
    out = {}
    for r in found.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbor"])
        assert r["rank"] == len(out[r["id"]])
    return out


def test_nearest_within_eps(spark, no_pairs):
    """F9, F4."""
    points = dense(60)
    df = in_memory(spark, points)
    assert by_rank(k_nearest(df, 0.05, 4)) == near(points, points, 0.05, 4)
    got = {r["id"]: r["core_dist"] for r in core_distances(df, 0.05, 4).collect()}
    want = near(points, points, 0.05, 4)
    assert set(got) == {p[0] for p in points}
    assert {i for i, d in got.items() if d is None} == {i for i, _, _ in points if len(want[i]) < 4}


def test_nearest_of_others(spark, no_pairs):
    """points that ask need not be among those found, nor near any; those at no place find none."""
    points = dense(60)
    asked = [(1000 + i, x + 0.01, y) for i, x, y in dense(20, 8, 0.1)] + [(2000, 30.0, 30.0), (2001, float("nan"), 0.3), (2002, float("inf"), 0.3)]
    odd = [*points, (5000, float("nan"), 0.31), (5001, 0.31, float("-inf"))]
    assert by_rank(k_nearest(in_memory(spark, odd), 0.05, 1, in_memory(spark, asked))) == near(asked, points, 0.05, 1)


def test_links_make_the_components_of_all_pairs(spark):
    """in proportion to the points."""
    points = dense(100)
    df = in_memory(spark, points)
    pairs = neighbors.neighbor_pairs(df, df, 0.05).where("i < j")
    links = cell_links(df, 0.05)
    assert sorted(map(tuple, connected_components(links).collect())) == sorted(map(tuple, connected_components(pairs, "i", "j").collect()))
    assert links.count() < 2 * len(points) < pairs.count()


def test_declarative_labels_without_pairs(spark, no_pairs):
    """F8."""
    points = dense(60)
    for eps, k in ((0.05, 4),):
        assert labels(C.dbscan_declarative(in_memory(spark, points), eps, k)) == brute(points, eps, k)


def test_leaves_are_copied_once_and_not_gathered(spark):
    """copies of leaves go on as the join gives them."""
    df = in_memory(spark, dense(60))
    found = plan_partitions(spark, df, 0.05, 6, halvings=5)
    copies = leaf_copies(df, found, 0.05)
    assert copies.count() == copies.select("pid", "id").distinct().count() > 0
    assert "Aggregate" not in copies._jdf.queryExecution().optimizedPlan().toString()


def test_cut_cells_are_clustered_without_leaf_copies(spark, monkeypatch):
    """what goes to kernels stays in proportion to the points."""
    points, sent = dense(60), []
    real = C.local_labels

    def seen(copies, *args):
        sent.append(copies.count())
        return real(copies, *args)

    monkeypatch.setattr(C, "local_labels", seen)
    for eps, k in ((0.05, 4),):
        assert labels(C.dbscan(in_memory(spark, points), eps, k, 6, halvings=5)) == brute(points, eps, k)
    assert max(sent) <= 9 * len(points)
