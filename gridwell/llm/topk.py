"""Exact top-k by integer inner product, through histograms of scores.

Every query of a block is scored against every row, without keeping the scores.
Each task counts its scores in equal bins of the range that may still hold the
query's kth value, and reports only bins at or above its own kth value: the
global kth value can't be lower. The summed counts say which bin holds the kth
value; that bin is the next, narrower range, until it is one value wide. A last
pass emits what lies above, and of the ties at the kth value those of the
smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwell.session import drop_written, scratch_path, written

BLOCK = 2048
BINS = 1024
ROWS = 2048
_EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """The ``k`` highest-scoring rows for each query: query_id, rank, vec_id, score.

    Both inputs have ``vec_id`` and ``embedding``. A component becomes
    floor(scale * x); the score is the integer inner product, kept within a long.
    A row with a null id, a null vector, or a null or non-finite component takes no
    part; vectors of unequal length are compared over the shorter one's components.
    A query's candidates are the rows of another vec_id; fewer than ``k`` are all
    returned. Ties go to the smaller vec_id. Repeated rows are separate candidates;
    of queries that repeat a vec_id the least vector counts. No queries or no
    candidates give no rows.

    Queries are taken in blocks of ``block``, in the order of their ids; only a
    block is held by the driver and sent to executors.
    """
    spark = vectors.sparkSession
    rows = _sound(vectors)
    asked = written(_sound(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    path = scratch_path(spark, "topk")
    last = None
    while True:
        some = asked if last is None else asked.where(F.col("vec_id") > last)
        # ids alone tell where the block ends: of the vectors only its own reach the driver
        end = some.select("vec_id").orderBy("vec_id").limit(block).agg(F.max("vec_id")).first()[0]
        part = [] if end is None else some.where(F.col("vec_id") <= end).orderBy("vec_id").collect()
        _block(rows, part, k, scale).write.mode("append").parquet(path)
        if len(part) < block:
            break
        last = part[-1]["vec_id"]
    drop_written(asked)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def _sound(vectors: DataFrame) -> DataFrame:
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)


def _scaled(flat: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(flat * scale)


def _matrix(batch: pa.RecordBatch, scale: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scaled components; short vectors end in zeros, long ones are cut to ``width``."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    flat = _scaled(lists.flatten().to_numpy(zero_copy_only=False), scale)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return ids, flat.reshape(len(ids), width)
    out = np.zeros((len(ids), width))
    at = 0
    for i, size in enumerate(sizes):
        n = min(size, width)
        out[i, :n] = flat[at : at + n]
        at += size
    return ids, out


def _scores(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products, rows by queries, as int64."""
    if not m.size or not q.size:
        return np.zeros((len(m), len(q)), np.int64)
    if np.abs(m).max() * np.abs(q).max() * m.shape[1] < _EXACT:
        return (m @ q.T).astype(np.int64)
    wide = np.vectorize(int, otypes=[object])
    exact = wide(m) @ wide(q).T
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


class _Scorer:
    """Scores a task's rows against a block of queries, a bounded number at a time."""

    def __init__(self, shared, scale: float):
        self.ids, self.q = shared.value
        self.scale = scale

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, scores and which of them count (all but the query's own)."""
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, m = _matrix(batch.slice(at, ROWS), self.scale, self.q.shape[1])
                yield ids, _scores(m, self.q), ids[:, None] != self.ids[None, :]


def _block(rows: DataFrame, part: list, k: int, scale: float) -> DataFrame:
    spark = rows.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not part or k < 1:
        return none
    width = max(len(r["embedding"]) for r in part)
    q = np.zeros((len(part), width))
    for i, r in enumerate(part):
        q[i, : len(r["embedding"])] = _scaled(np.array(r["embedding"], float), scale)
    shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in part], np.int64), q))
    scorer = _Scorer(shared, scale)
    n = len(part)

    def extent(batches):
        low, high, count = np.full(n, _MOST), np.full(n, _LEAST), np.zeros(n, np.int64)
        for _, s, ok in scorer(batches):
            low = np.minimum(low, np.where(ok, s, _MOST).min(0))
            high = np.maximum(high, np.where(ok, s, _LEAST).max(0))
            count += ok.sum(0)
        yield _batch(np.flatnonzero(count), ("low", low), ("high", high), ("count", count))

    found = (
        rows.mapInArrow(extent, "q int, low long, high long, count long")
        .groupBy("q")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("count").alias("count"))
        .collect()
    )
    # Python integers: a range may be as wide as all longs.
    low, high, need = [0] * n, [-1] * n, [0] * n
    for r in found:
        low[r["q"]], high[r["q"]], need[r["q"]] = r["low"], r["high"], min(k, r["count"])
    while any(need[i] and low[i] < high[i] for i in range(n)):
        step = [max(1, -(-(high[i] - low[i] + 1) // BINS)) for i in range(n)]
        kth = _kth_bins(rows, scorer, low, high, step, need)
        for i, (b, above) in kth.items():
            need[i] -= above
            low[i], high[i] = low[i] + b * step[i], min(high[i], low[i] + (b + 1) * step[i] - 1)
    floor = np.array([low[i] if need[i] else _MOST for i in range(n)], np.int64)
    asks = np.array([need[i] > 0 for i in range(n)])

    def final(batches):
        for ids, s, ok in scorer(batches):
            above = ok & (s > floor) & asks
            i, j = np.nonzero(above)
            tied = ok & (s == floor) & asks
            ti, tj = np.nonzero(tied)
            order = np.lexsort((ids[ti], tj))
            ti, tj = ti[order], tj[order]
            first = np.concatenate([[True], tj[1:] != tj[:-1]]) if len(tj) else np.zeros(0, bool)
            start = np.flatnonzero(first)
            place = np.arange(len(tj)) - np.repeat(start, np.diff(np.append(start, len(tj))))
            ti, tj = ti[place < k], tj[place < k]
            i, j = np.append(i, ti), np.append(j, tj)
            yield pa.RecordBatch.from_arrays([pa.array(scorer.ids[j], pa.int64()), pa.array(ids[i], pa.int64()), pa.array(s[i, j], pa.int64())], ["query_id", "vec_id", "score"])

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        rows.mapInArrow(final, "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _kth_bins(rows: DataFrame, scorer: _Scorer, low: list, high: list, step: list, need: list) -> dict[int, tuple[int, int]]:
    """For each query with an open range: the bin of its kth value, and the count above it."""
    open_ = [i for i in range(len(need)) if need[i] and low[i] < high[i]]
    lo, hi, width = (np.array([x[i] for i in open_], np.int64) for x in (low, high, step))
    wanted = np.array([need[i] for i in open_], np.int64)
    column = np.arange(len(open_))

    def count(batches):
        bins = np.zeros(len(open_) * BINS, np.int64)
        for _, s, ok in scorer(batches):
            s, ok = s[:, open_], ok[:, open_] & (s[:, open_] >= lo) & (s[:, open_] <= hi)
            # unsigned: the difference may exceed a long
            b = (s.view(np.uint64) - lo.view(np.uint64)) // width.view(np.uint64)
            bins += np.bincount((column * BINS + b.astype(np.int64))[ok], minlength=len(bins))
        bins = bins.reshape(len(open_), BINS)
        reach = np.cumsum(bins[:, ::-1], 1)[:, ::-1]
        keep = (bins > 0) & (reach - bins < wanted[:, None])
        i, b = np.nonzero(keep)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(b, pa.int32()), pa.array(bins[i, b], pa.int64())], ["q", "bin", "n"])

    w = Window.partitionBy("q").orderBy(F.desc("bin"))
    total = rows.mapInArrow(count, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    want = F.element_at(F.lit([int(x) for x in wanted]), F.col("q") + 1)
    hit = total.withColumn("reach", above).where((F.col("reach") >= want) & (F.col("reach") - F.col("n") < want))
    return {open_[r["q"]]: (r["bin"], r["reach"] - r["n"]) for r in hit.collect()}


def _batch(index: np.ndarray, *columns: tuple[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), *(pa.array(c[index], pa.int64()) for _, c in columns)], ["q", *(name for name, _ in columns)])
