import math

import numpy as np

from gridwell.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, ids, k):
    def sound(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and sound(v)]
    out = []
    for q in sorted(ids):
        mine = min(v for i, v in rows if i == q and sound(v))
        mine = [math.floor(256 * x) for x in mine]
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(mine, v)))), i) for i, v in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def run(spark, rows, ids, k=5, block=2):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = df.where(df["vec_id"].isin(ids))
    got = top_k(df, asked, k, block=block).orderBy("query_id", "rank").collect()
    return [tuple(r) for r in got]


def test_random_vectors_ties_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(20)]
    ids = [0, 3, 7, 100, 119]
    assert run(spark, rows, ids) == brute(rows, ids, 5)


def test_odd_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [0.5, -0.5]), (6, [0.5, -0.5]), (7, [1e9, 1e9]), (8, [1e30, -1e3])]
    assert run(spark, rows, [1, 6, 7, 8], 3) == brute(rows, [1, 6, 7, 8], 3)


def test_few_or_no_candidates(spark):
    assert run(spark, [(1, [0.5])], [1]) == []
    assert run(spark, [], []) == []
    assert run(spark, [(1, [0.5]), (2, [0.25])], [1]) == [(1, 1, 2, 128 * 64)]


def test_extra_columns_with_inner_names(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(i % 5), 1.0]) for i in range(20)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    odd = v.select("*", *(F.lit(1).alias(c) for c in ("q", "score", "rank", "low", "high", "n", "bin", "query_id")))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(top_k(odd, odd.where("vec_id < 4"), 3)) == key(top_k(v, v.where("vec_id < 4"), 3, block=2))
