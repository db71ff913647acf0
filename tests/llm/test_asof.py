import hashlib
import random

import numpy as np
import pytest

from gridwell.llm import asof


def test_blocks_cover_what_they_should():
    for low in range(9):
        for high in range(low + 1, 40):
            level, second = (int(v[0]) for v in asof.blocks_cover(np.array([low]), np.array([high])))
            assert {*range(low, low + 2**level), *range(second, second + 2**level)} == set(range(low, high))


def test_winners_against_all_intervals():
    rng = random.Random(1)
    for size in (1, 2, 7, 64):
        low = np.array([rng.randrange(size) for _ in range(40)])
        high = np.array([rng.randint(a + 1, size) for a in low])
        rank = np.array(rng.sample(range(40), 40))
        level, second = asof.blocks_cover(low, high)
        got = asof.winners(np.append(level, level), np.append(low, second), np.append(rank, rank), size)
        assert got.tolist() == [max((r for a, b, r in zip(low, high, rank, strict=True) if a <= t < b), default=-1) for t in range(size)]


@pytest.mark.parametrize("shard", [8, 64, 4096])
def test_as_of_against_brute_force(spark, shard):
    """Short and long intervals, negative times, ties in all but the version, empty intervals, nulls and repeated rows."""
    rng = random.Random(2)
    versions = []
    for i in range(300):
        event = rng.randrange(-100, 400)
        arrival = event + rng.randrange(-20, 60)
        versions.append((rng.choice("aab") if i % 9 else "c", i, event, arrival, event + rng.choice([0, 5, 30, 300, 900])))
    versions += [("a", 1000 + i, 50, 50, 90) for i in range(4)] + versions[:20]
    odd = [(None, 2000, 0, 0, 900), ("a", None, 399, 0, 900), ("a", 2001, None, 0, 900), ("a", 2002, 0, None, 900), ("a", 2003, 0, 0, None)]
    asked = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([None, *range(-150, 1300)])) for _ in range(900)]
    v = spark.createDataFrame(versions + odd, "entity string, version long, event long, arrival long, expiry long")
    got = asof.as_of(v, spark.createDataFrame(asked, "entity string, t long"), shard).collect()
    want = {}
    for e, t in set(asked):
        usable = [(event, -arrival, i) for entity, i, event, arrival, expiry in versions if entity == e and t is not None and event <= t and arrival <= t < expiry]
        if usable:
            want[e, t] = (max(usable)[2], max(usable)[0])
    assert len(got) == len(want) and {(r["entity"], r["t"]): (r["version"], r["event"]) for r in got} == want


def brute_features(docs, labels):
    def hashed(i):
        h = hashlib.sha256(str(i).encode()).hexdigest()
        a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        event = a % 50000
        return event, event - 60 + b % 600, event + c % 900, d % 50000

    out = []
    for i in labels:
        t = None if i is None else hashed(i)[3]
        sources = [s for j, s, _, _ in docs if j == i and s is not None and i is not None]
        best = None
        for j, s, n, lang in docs:
            if sources and s == min(sources) and j is not None:
                event, arrival, expiry, _ = hashed(j)
                if event <= t and arrival <= t < expiry:
                    best = max(best or (), (event, -arrival, j, n, lang))
        if best is None:
            out.append((i, t, None, None, "none", None, None))
        elif t - best[0] > 120:
            out.append((i, t, best[2], t - best[0], "stale", None, None))
        else:
            out.append((i, t, best[2], t - best[0], "fresh", best[3], best[4]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [512, 1 << 16])
def test_features_at_labels(spark, shard):
    """A hot source, nulls, repeated rows and labels, labels without a document, clashing columns."""
    rng = random.Random(3)
    docs = [(i, rng.choice(["hot", "hot", "a", "b"]), rng.randrange(900), rng.choice(["en", "de"])) for i in range(700)]
    docs += docs[:30] + [(None, "hot", 5, "en"), (800, None, 5, "en"), (801, "", 7, "fr"), (5, "zz", 1, "en")]
    labels = [*range(0, 700, 2), 800, 801, 9999, None, 4, 4, 5]
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, source string, n_chars long, lang string, entity string, t long, level long")
    got = asof.features_at_labels(d, spark.createDataFrame([(i, "x") for i in labels], "doc_id long, source string"), shard).collect()
    want = brute_features(docs, labels)
    assert sorted(map(tuple, got), key=repr) == want
    assert {r[4] for r in want} == {"none", "stale", "fresh"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, n_chars long, lang string")
    labels = spark.createDataFrame([(1,)], "doc_id long")
    assert [r["status"] for r in asof.features_at_labels(docs, labels).collect()] == ["none"]
    assert asof.features_at_labels(docs, labels.limit(0)).collect() == []


def test_plan_has_no_loops_and_no_single_task(spark):
    docs = spark.createDataFrame([(i, "a", 1, "en") for i in range(50)], "doc_id long, source string, n_chars long, lang string")
    plan = asof.features_at_labels(docs, docs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan
