"""Best-fit packing of tokenised documents into sequences of a fixed length.

Whole sequences aside, a piece's length is all that matters to a packing, and
there are only as many lengths as tokens in a sequence. The packing is therefore
worked out for counts of lengths, exactly as it would be piece by piece:

* pieces above a third of the capacity can only pair: from the longest down, each
  is matched with the longest that still fits beside it, which needs the fewest
  sequences;
* shorter pieces, longest first, go into the smallest gap that takes them, and
  open a sequence only if none does.

The plan is a list of runs "so many pieces of this length go, m to a sequence, at
this offset of sequences a, a+1, ...". Pieces take their places by their rank
within their length, which is counted in salted groups.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwell.llm.text import encoder, pieces_by_size
from gridwell.session import written

CAPACITY = 2048


def _tokenised(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, True)
        end = int(end_id).to_bytes(4, "little")
        for batch in pieces_by_size(batches, 1):
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, own in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                raw = own.tobytes() + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    doc.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part)
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: doc_id, piece, start, length,
    ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit).

    ``end_id`` ends each document; a null or empty text is that id alone. Only
    longer documents are cut.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tokenised(vocabulary, end_id, capacity, with_ids), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces in a sequence, offset).

    A run's piece r goes to sequence ``first + r // m`` at ``offset + r % m * length``.
    """
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is empty or longer than a sequence")
    ranks: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[list[int]]] = {}  # gap -> [first sequence, sequences]
    order: list[int] = []  # gaps in ascending order
    opened = 0

    def put(length: int, number: int, first: int, each: int, offset: int) -> None:
        runs.append((length, ranks[length], number, first, each, offset))
        ranks[length] += number

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append([first, number])

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        if at >= 0 and large[at] == n and left[n] == 1:
            at -= 1  # it can't pair with itself
        mate = large[at] if at >= 0 else 0
        if not mate:
            put(n, left[n], opened, 1, 0)
            leave(capacity - n, opened, left[n])
            opened += left.pop(n)
            large.pop()
        elif mate == n:
            twos = left[n] // 2
            put(n, 2 * twos, opened, 2, 0)
            leave(capacity - 2 * n, opened, twos)
            opened += twos
            left[n] -= 2 * twos
            if not left[n]:
                del left[n]
                large.pop()
        else:
            both = min(left[n], left[mate])
            put(n, both, opened, 1, 0)
            put(mate, both, opened, 1, n)
            leave(capacity - n - mate, opened, both)
            opened += both
            for x in (n, mate):
                left[x] -= both
                if not left[x]:
                    del left[x]
                    large.remove(x)
    for n in sorted(left, reverse=True):
        number = left[n]
        while number:
            at = bisect_left(order, n)
            if at == len(order):
                each = min(capacity // n, number)
                full = number // each
                put(n, full * each, opened, each, 0)
                leave(capacity - each * n, opened, full)
                opened += full
                number -= full * each
                continue
            gap = order[at]
            first, free = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each = min(gap // n, number)
            full = min(free, number // each)
            put(n, full * each, first, each, capacity - gap)
            leave(gap - each * n, first, full)
            leave(gap, first + full, free - full)
            number -= full * each
    return runs


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (any columns, with doc_id, piece, ids_crc32 and length) with sequence_id and offset.

    ``parts`` is read more than once and should be a written table. Offsets in a
    sequence have no gaps; repeated rows are packed as often as they occur; an empty
    table gives an empty result.
    """
    spark = parts.sparkSession
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(counts, capacity))
    shared = spark.sparkContext.broadcast(tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else None)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = groups.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(offsets, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    kept = [c for c in parts.columns if c not in ("length", "sequence_id", "offset")]
    ranked = ranked.select("length", F.col("rank").cast("long"), *kept)
    schema = parts.select("length", *kept).schema.add("sequence_id", "long").add("offset", "long")

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, first_rank, _, first, each, offset = shared.value
            n, r = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            # runs are ordered by length and first rank: one composite key finds the run
            wide = np.int64(1 << 50)
            at = np.searchsorted(length * wide + first_rank, n * wide + r, "right") - 1
            k = r - first_rank[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(first[at] + k // each[at]), pa.array(offset[at] + k % each[at] * n)],
                ["length", *kept, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(located, schema)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    Reads doc_id and text only. A null or empty text is one piece of the end id; a
    repeated row is packed again; a null doc_id is carried; an empty table gives none.
    """
    parts = written(token_pieces(docs, vocabulary, end_id, capacity), "pieces")
    return place(parts, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array<int>), doc_ids, lengths."""
    parts = place(written(token_pieces(docs, vocabulary, end_id, capacity, True), "pieces"), capacity)
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(2), batch.column(3)], ["sequence_id", "ids", "doc_ids", "lengths"])

    joined = F.aggregate("xs", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return (
        parts.groupBy("sequence_id")
        .agg(ordered.alias("xs"))
        .select("sequence_id", joined.alias("ids"), F.col("xs.doc_id").alias("doc_ids"), F.col("xs.length").alias("lengths"))
        .mapInArrow(opened, "sequence_id long, ids array<int>, doc_ids array<long>, lengths array<long>")
    )
