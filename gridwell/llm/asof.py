"""Point-in-time joins: the value that was known, and still valid, when a row asked.

Reverse sparse tables: a version is usable in an interval of times. An interval is
covered by two overlapping blocks of a power of two, each block keeps the winner among
the versions that put it there (NumPy's ``maximum.at``), and winners are pushed down
level by level, until each single time has its own and can be indexed.

Time is cut into shards of ``SHARD`` ticks. Spark takes the winner of every block first,
map-side and then by shuffle, so that a task gets one row for each of a shard's blocks
at most, ``SHARD * (log2(SHARD) + 1)`` of them however many versions an entity has. An
interval that spans whole shards is not cut into all of them: it puts two blocks into a
table of shards, whose own winners come down as one block that is a whole shard. What
is asked goes through as the distinct times of an entity, and answers are joined back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ticks of a shard: a power of two. What an entity has is spread over as many groups as
#: it has shards, so that small ones even out an entity with many versions.
SHARD = 1 << 8

_BEST = "event long, late long, version long"


def blocks_cover(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level and second start of the two blocks that cover each [low, high)."""
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    return level, high - (1 << level)


def winners(level: np.ndarray, start: np.ndarray, rank: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` places the largest rank of a block [start, start + 2^level)
    that holds it, or -1."""
    top = int(level.max(initial=0))
    table = np.full((top + 1, size), -1, np.int64)
    np.maximum.at(table, (level, start), rank)
    for k in range(top, 0, -1):
        half = 1 << (k - 1)
        np.maximum(table[k - 1], table[k], out=table[k - 1])
        np.maximum(table[k - 1, half:], table[k, : size - half], out=table[k - 1, half:])
    return table[0]


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _kernel(by: list[str], size: int | None):
    """The winner of each asked place; ``size``: all places are below it."""

    def run(key: tuple, blocks: pa.Table, asked: pa.Table) -> pa.Table:
        (at,) = _numbers(asked, "at")
        hit, found = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
        if blocks.num_rows and len(at):
            level, start, *best = _numbers(blocks, "level", "start", "event", "late", "version")
            first, end = (0, size) if size else (int(start.min()), int((start + (1 << level.astype(np.int64))).max()))
            order = np.lexsort(best[::-1])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            won = winners(level, start - first, rank, end - first)
            hit = np.flatnonzero((at >= first) & (at < end))
            r = won[at[hit] - first]
            hit, r = hit[r >= 0], r[r >= 0]
            found = np.stack(best, 1)[order[r]]
        keys = [pa.repeat(k, len(hit)) for k in key]
        return pa.table([*keys, pa.array(at[hit]), *(pa.array(c) for c in found.T)], names=[*by, "at", "event", "late", "version"])

    return run


def _blocks(low: Column, high: Column) -> Column:
    """The two blocks (level, start) that cover a non-empty [low, high)."""
    level = F.length(F.conv((high - low).cast("string"), 10, 2)) - 1
    second = high - F.call_function("shiftleft", F.lit(1).cast("long"), level)
    return F.explode(F.array_distinct(F.array(*(F.struct(level.alias("level"), s.cast("long").alias("start")) for s in (low, second)))))


def _best(blocks: DataFrame, *by: str) -> DataFrame:
    """One row a block, with its winner: the latest event, then the earliest arrival, then the largest version."""
    best = F.max(F.struct("event", "late", "version"))
    return blocks.groupBy(*by, "level", "start").agg(best.alias("w")).select(*by, "level", "start", "w.*")


def as_of(versions: DataFrame, asked: DataFrame, shard: int = SHARD) -> DataFrame:
    """(entity, t, version, event) for the distinct (entity, t) of ``asked`` that have a usable version.

    ``versions``: entity, version, event, arrival, expiry (times are longs, in ticks). A
    version is usable at t if event <= t and arrival <= t < expiry. The latest event
    wins, then the earliest arrival, then the largest version. Rows with a null and
    versions that are never usable take no part, repeated rows count once. An empty
    table gives an empty result.
    """
    names = ["entity", "version", "event", "arrival", "expiry"]
    known = versions.select(*names).na.drop().select(
        "entity", F.col("version").cast("long").alias("version"), F.col("event").cast("long").alias("event"), (-F.col("arrival")).cast("long").alias("late"),
        F.greatest("event", "arrival").cast("long").alias("low"), F.col("expiry").cast("long").alias("high"),
    ).where("low < high")
    s, bits = F.lit(shard).cast("long"), shard.bit_length() - 1
    times = asked.select("entity", F.col("t").cast("long").alias("t")).na.drop().distinct()
    times = times.select("entity", F.shiftright("t", bits).alias("shard"), F.pmod("t", s).alias("at"), "t")
    # shards that an interval fills: from the first one that starts in it to the last that ends in it
    cut = known.withColumns({"from": F.shiftright(F.col("low") + s - 1, bits), "to": F.shiftright("high", bits)})
    whole = cut.where(F.col("from") < F.col("to")).select("entity", "event", "late", "version", _blocks(F.col("from"), F.col("to")).alias("b"))
    whole = _best(whole.select("entity", "event", "late", "version", "b.*"), "entity")
    kind = versions.schema["entity"].dataType.simpleString()
    of_shards = times.select("entity", F.col("shard").alias("at")).distinct()
    filled = whole.groupBy("entity").cogroup(of_shards.groupBy("entity")).applyInArrow(_kernel(["entity"], None), f"entity {kind}, at long, {_BEST}")
    filled = filled.select("entity", F.col("at").alias("shard"), "event", "late", "version", F.lit(bits).alias("level"), F.lit(0).cast("long").alias("start"))
    # what sticks out at both ends, or lies within one shard
    lows, highs = F.shiftright("low", bits), F.shiftright(F.col("high") - 1, bits)
    piece = lambda k: F.struct(k.alias("shard"), (F.greatest(F.col("low"), k * s) - k * s).alias("a"), (F.least(F.col("high"), (k + 1) * s) - k * s).alias("z"))
    ends = F.filter(F.array_distinct(F.array(piece(lows), piece(highs))), lambda p: p["z"] - p["a"] < s)
    parts = known.select("entity", "event", "late", "version", F.explode(ends).alias("p")).select("entity", "event", "late", "version", "p.*")
    parts = parts.select("entity", "shard", "event", "late", "version", _blocks(F.col("a"), F.col("z")).alias("b")).select("entity", "shard", "event", "late", "version", "b.*")
    cells = _best(parts.unionByName(filled.select(*parts.columns)), "entity", "shard")
    found = cells.groupBy("entity", "shard").cogroup(times.drop("t").groupBy("entity", "shard")).applyInArrow(_kernel(["entity", "shard"], shard), f"entity {kind}, shard long, at long, {_BEST}")
    return found.select("entity", (F.col("shard") * s + F.col("at")).alias("t"), "version", "event")


STALE = 120


def hashed_times(key: str = "doc_id") -> list[Column]:
    """Four numbers below 2^32 from the first digits of the hash of a decimal id."""
    digest = F.sha2(F.col(key).cast("string"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def features_at_labels(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per row of ``labels``: doc_id, t, version_id, age, status, n_chars, lang.

    Rows of ``docs`` (doc_id, source, n_chars, lang) are versions of their source, with
    times from a hash of doc_id; a label asks for its document's source. A document of
    several rows belongs to the least of its sources, and its values are those of its
    largest (n_chars, lang) in the winning source. Versions and labels without doc_id or
    source find nothing: status ``none``. Other columns are not read.
    """
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), F.col("lang").cast("string").alias("lang"))
    doc = doc.where("doc_id is not null and source is not null")
    a, b, c, d = hashed_times()
    event = F.pmod(a, F.lit(50000))
    versions = doc.select(F.col("source").alias("entity"), F.col("doc_id").alias("version"), event.alias("event"), (event - 60 + F.pmod(b, F.lit(600))).alias("arrival"), (event + F.pmod(c, F.lit(900))).alias("expiry"))
    asks = labels.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("t", F.pmod(d, F.lit(50000)))
    source = doc.groupBy("doc_id").agg(F.min("source").alias("entity"))
    asks = asks.join(source, "doc_id", "left")
    found = as_of(versions, asks, shard)
    values = doc.groupBy("doc_id", "source").agg(F.max(F.struct("n_chars", "lang")).alias("v"))
    values = values.select(F.col("doc_id").alias("version"), F.col("source").alias("entity"), "v.n_chars", "v.lang")
    told = asks.join(found, ["entity", "t"], "left").withColumn("age", F.col("t") - F.col("event"))
    status = F.when(F.col("version").isNull(), "none").when(F.col("age") > STALE, "stale").otherwise("fresh")
    told = told.withColumn("status", status).withColumn("fresh", F.when(F.col("status") == "fresh", F.col("version")))
    named = told.join(values.withColumnRenamed("version", "fresh"), ["fresh", "entity"], "left")
    return named.select("doc_id", "t", F.col("version").alias("version_id"), "age", "status", "n_chars", "lang")
