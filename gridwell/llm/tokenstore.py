"""Token-id files: one zstandard frame per document over a shared dictionary.

A file set is a table of blocks in the shared folder, each block a byte string:

    magic "TIDBLK02" | dictionary hash (32 bytes, SHA-256) | bytes per id (1) |
    documents (4) | index: doc_id, start, ids, frame offset, frame length (8 each,
    per document), whether doc_id is known (1) | frames

All integers are little-endian. Blocks are written and read through Spark, so that
they live in any store it reaches and survive lost executors. The dictionary is
stored beside them under its hash; a block names the hash it needs. A document is
read by its index entry alone, without its neighbours.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from gridwell.llm.text import encoder, pieces, pieces_by_size
from gridwell.session import scratch_path

MAGIC = b"TIDBLK02"
END_ID = 2
#: The dictionary is trained from the whole ids of these documents, those of the
#: smallest hashes, or of as many of them as give so many bytes.
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 6 << 20
DICTIONARY_BYTES = 65536
BLOCK_BYTES = 8 << 20
#: Bytes of text that a part is planned for.
PART_BYTES = 32 << 20
#: Parts whose starts are summed up together.
PARTS_IN_A_GROUP = 1024
LEVEL = 3

_HEAD = struct.Struct("<8s32sBI")
_ENTRY = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("ids", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("known", "u1")])


@dataclass(frozen=True)
class TokenFiles:
    """Where a file set lies: blocks, starts of its parts, and dictionaries by hash."""

    path: str


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; what is too little to train from serves as it is."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _codec(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def _width(enc) -> int:
    """Bytes an id takes in a file: two if the whole vocabulary fits."""
    return 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4


def _block(digest: bytes, width: int, entries: list[tuple], frames: list[bytes]) -> bytes:
    return b"".join([_HEAD.pack(MAGIC, digest, width, len(entries)), np.array(entries, _ENTRY).tobytes(), *frames])


def _sample(source: DataFrame, total: int) -> list[str]:
    """Whole texts of the ``SAMPLE_DOCS`` documents of the smallest hashes, or of as many
    of them as give ``SAMPLE_BYTES``; rows of one hash count once. ``total``: all rows."""
    texts = source.where("text is not null").select(F.xxhash64("doc_id", F.length("text")).alias("h"), F.length("text").alias("n"), "text")
    # hashes are spread evenly: some four times as many as are wanted lie below the limit
    share = 4 * SAMPLE_DOCS / max(1, total)
    while True:
        below = texts if share >= 1 else texts.where(F.col("h") < F.lit(int(share * (1 << 64)) - (1 << 63)))
        found = below.select("h", "n").groupBy("h").agg(F.max("n").alias("n")).orderBy("h").limit(SAMPLE_DOCS).collect()
        if len(found) >= SAMPLE_DOCS or share >= 1:
            break
        share *= 8
    before = np.cumsum([0, *(r["n"] for r in found)])
    chosen = [r["h"] for r, held in zip(found, before, strict=False) if held < SAMPLE_BYTES]
    if not chosen:
        return []
    own = texts.where(F.col("h") <= chosen[-1]).groupBy("h").agg(F.max("text").alias("text"))
    return [r["text"] for r in own.orderBy("h").collect()]


def write(docs: DataFrame, vocabulary: str, end_id: int = END_ID, path: str | None = None) -> TokenFiles:
    """Encode every whole text and write the file set, in ascending doc_id order.

    Documents are dealt by ranges of (doc_id, text hash), so that a doc_id repeated
    with other texts does not gather in one task; null doc_ids come first. A null or
    empty text is the end id alone. Starts within a part are stored in its blocks, the
    parts' own starts in a table of one row per part.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    enc = encoder(vocabulary, False)
    width = _width(enc)
    total, size = source.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    data = _dictionary([_stored(ids, width) for ids in enc.encode(_sample(source, total)) if len(ids)])
    digest = hashlib.sha256(data).digest()
    shared = spark.sparkContext.broadcast(data)
    end = np.uint32(end_id)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(vocabulary, False)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec(shared.value), write_checksum=False)
        start = number = 0
        entries, frames, held = [], [], 0
        for batch in pieces_by_size(batches, 1):
            for doc, own in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                ids = np.append(own, end)
                frame = packer.compress(_stored(ids, width))
                entries.append((doc or 0, start, len(ids), held, len(frame), doc is not None))
                frames.append(frame)
                start += len(ids)
                held += len(frame)
                if held >= BLOCK_BYTES:
                    yield _row(part, number, start, _block(digest, width, entries, frames))
                    number, entries, frames, held = number + 1, [], [], 0
        if entries:
            yield _row(part, number, start, _block(digest, width, entries, frames))

    keys = ["doc_id", F.xxhash64("text")]
    parts = max(-(-(size or 0) // PART_BYTES), spark.sparkContext.defaultParallelism)
    dealt = source.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt.mapInArrow(encoded, "part int, number int, ids long, block binary").write.parquet(f"{path}/blocks")
    spark.createDataFrame([Row(hash=digest.hex(), data=bytearray(data))], "hash string, data binary").coalesce(1).write.parquet(f"{path}/dictionaries")
    _starts(spark.read.schema("part int, ids long").parquet(f"{path}/blocks")).write.parquet(f"{path}/parts")
    return TokenFiles(path)


def _starts(blocks: DataFrame) -> DataFrame:
    """How many ids lie before each part: within its group of parts by a window, before
    the group by sums of groups, of which the driver gets one for ``PARTS_IN_A_GROUP`` parts."""
    sizes = blocks.groupBy("part").agg(F.max("ids").alias("ids")).withColumn("group", F.floor(F.col("part") / PARTS_IN_A_GROUP))
    groups, at = [], 0
    for r in sizes.groupBy("group").agg(F.sum("ids").alias("ids")).orderBy("group").collect():
        groups.append((r["group"], at))
        at += r["ids"]
    earlier = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))
    known = blocks.sparkSession.createDataFrame(groups, "group long, before long")
    return inside.join(F.broadcast(known), "group").select("part", (F.col("before") + F.col("inside")).alias("before"))


def _stored(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def _row(part: int, number: int, ids: int, block: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([ids], pa.int64()), pa.array([block], pa.binary())], ["part", "number", "ids", "block"])


def index(block: bytes, dictionaries: dict[bytes, bytes]) -> tuple[np.ndarray, int, int, zstandard.ZstdDecompressor]:
    """A block's index, bytes per id, place of its frames, and its decompressor."""
    magic, digest, width, count = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    if digest not in dictionaries:
        raise KeyError(f"dictionary {digest.hex()} is missing")
    entries = np.frombuffer(block, _ENTRY, count, _HEAD.size)
    return entries, width, _HEAD.size + count * _ENTRY.itemsize, zstandard.ZstdDecompressor(dict_data=_codec(dictionaries[digest]))


def document(block: bytes, dictionaries: dict[bytes, bytes], doc_id: int) -> np.ndarray:
    """One document's ids, read by its index entry alone."""
    entries, width, base, opener = index(block, dictionaries)
    e = entries[np.flatnonzero((entries["doc_id"] == doc_id) & (entries["known"] == 1))[0]]
    at = base + int(e["offset"])
    return np.frombuffer(opener.decompress(block[at : at + int(e["length"])]), f"<u{width}").astype(np.uint32)


def dictionaries(spark: SparkSession, files: TokenFiles) -> dict[bytes, bytes]:
    """The file set's dictionaries, checked against their hashes."""
    found = {}
    for r in spark.read.parquet(f"{files.path}/dictionaries").collect():
        data = bytes(r["data"])
        if hashlib.sha256(data).hexdigest() != r["hash"]:
            raise ValueError("a dictionary does not match its hash")
        found[bytes.fromhex(r["hash"])] = data
    return found


def read(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """The file set's documents: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` counts the ids of all documents before it.
    """
    shared = spark.sparkContext.broadcast(dictionaries(spark, files))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            before, block = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            entries, width, base, opener = index(block, shared.value)
            for at in range(0, len(entries), 1024):
                some, crc, ids = entries[at : at + 1024], [], []
                for e in some:
                    o = base + int(e["offset"])
                    got = np.frombuffer(opener.decompress(block[o : o + int(e["length"])]), f"<u{width}").astype("<u4")
                    if len(got) != e["ids"]:
                        raise ValueError("a frame and its index entry differ")
                    crc.append(zlib.crc32(got.tobytes()))
                    if with_ids:
                        ids.append(got)
                doc = pa.array(some["doc_id"], mask=some["known"] == 0)
                columns = [doc, pa.array(some["start"] + before), pa.array(some["ids"]), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    blocks = spark.read.schema("part int, number int, ids long, block binary").parquet(f"{files.path}/blocks")
    parts = spark.read.schema("part int, before long").parquet(f"{files.path}/parts")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.join(parts, "part").select("before", "block").mapInArrow(opened, schema)
