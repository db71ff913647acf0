"""Unbounded nearest neighbours and the spanning forest of density clusters."""

import random

import numpy as np
import pytest

from gridwell.operators.clustering import forest_cuts
from gridwell.operators.forest import minimum_spanning_forest
from gridwell.operators.nearest import k_nearest_anywhere
from gridwell.sources import in_memory


def brute(points, k):
    i, x, y = (np.array(c) for c in zip(*points, strict=True))
    d2 = (x[:, None] - x) * (x[:, None] - x) + (y[:, None] - y) * (y[:, None] - y)
    out = {}
    for p in range(len(i)):
        order = np.lexsort([i, d2[p]])[:k]
        out[int(i[p])] = [(int(i[q]), float(d2[p, q])) for q in order]
    return out


def nearest(df, k, side):
    found = {}
    for r in k_nearest_anywhere(df, k, side).orderBy("id", "rank").collect():
        own = found.setdefault(r["id"], [])
        own.append((r["neighbor"], r["d2"]))
        assert r["rank"] == len(own)
    return found


rng = random.Random(4)
CROWD = [(i, rng.gauss(0, 0.05), rng.gauss(0, 0.05)) for i in range(250)]
FAR = [(1000, 500.0, -300.0), (1001, -9000.0, 20.0), (1002, 500.0, -300.0), (1003, 3.0, 3.0)]
SAME = [(2000 + i, 7.0, 7.0) for i in range(60)]
LATTICE = [(3000 + i, 20 + (i % 12) * 0.5, (i // 12) * 0.5) for i in range(144)]


@pytest.mark.parametrize(("points", "k", "side"), [(CROWD + FAR + SAME + LATTICE, 5, 0.5), (CROWD + FAR, 12, 100.0), (FAR, 9, 1.0)])
def test_nearest_against_all_pairs(spark, points, k, side):
    """Outliers, coincident points, ties on a lattice, and fewer points than k."""
    assert nearest(in_memory(spark, points), k, side) == brute(points, k)


def test_nearest_of_none(spark):
    assert nearest(in_memory(spark, []), 3, 1.0) == {}


def kruskal(edges):
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    out = set()
    for w, i, j in sorted({(w, min(i, j), max(i, j)) for i, j, w in edges if None not in (i, j, w) and i != j}):
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            out.add((i, j, w))
    return out


def test_forest_against_kruskal(spark):
    """Ties, loops, repeated edges, nulls, a chain and a hub."""
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(5))) for _ in range(150)]
    edges += [(100 + i, 101 + i, 1.0 + i % 3) for i in range(60)] + [(300, 400 + i, 2.0) for i in range(60)] + [(None, 1, 1.0), (1, 2, None)]
    got = minimum_spanning_forest(spark.createDataFrame(edges, "i long, j long, w double")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == kruskal(edges)
    assert minimum_spanning_forest(spark.createDataFrame([], "i long, j long, w double")).collect() == []


def test_cuts_are_those_of_density_clusters(spark):
    from tests.test_clustering import brute as clusters

    rng = random.Random(6)
    points = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(220)] + [(500 + i, 5.0, 5.0) for i in range(6)] + [(600 + i, i * 0.25, 8.0) for i in range(30)]
    at = [0.5, 0.3, 0.25, 0.1]
    got = {}
    for r in forest_cuts(in_memory(spark, points), 0.5, 4, at).collect():
        got.setdefault(r["cut"], {})[r["id"]] = r["cluster_id"]
    for n, t in enumerate(at):
        assert got.get(n, {}) == {i: c for i, (f, c) in clusters(points, t, 4).items() if f == "CORE"}
