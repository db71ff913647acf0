"""Collocations: phrases whose words stand together more often than their parts would by chance.

Hierarchical pair naming. Texts are kept as blocks of word places. A frequent word of a
language gets an id, in the way of the pairs below; then, level by level, two adjacent frequent (k-1)-grams make a
k-gram, which is named by that pair. Each block counts its own distinct pairs and sends
them, packed and dealt to ranges by their hash, to where a range's pairs of all blocks are
added up; the frequent ones get ids, and each block is answered which of its pairs those
are: a phrase of k words can only be frequent where both its (k-1)-grams are, so that
places without a frequent one drop out. No n-gram is ever a row of its own, and no pair of
a block is one.

A pair is a k-gram's two parents. Following the first ones gives what it begins with,
following the second ones what it ends with, so the counts of all its cuts come from
joins with the level below, and a phrase is part of a longer one that is as frequent if
it is a parent of such a phrase one word longer (counts can't rise in between).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwell.llm.text import give_back, mix
from gridwell.session import drop_written, passing, written

#: Bytes of text in a block, if a single text isn't longer.
BLOCK_BYTES = 6 << 20
#: Ranges at least, and the blocks' words and places of grams that a range counts for.
LEAST_RANGES, WORDS_A_RANGE, GRAMS_A_RANGE = 64, 1 << 20, 2 << 20
#: Parts in which a language's phrases are ranked before they meet.
PARTS = 64

#: A-Z in lower case, breaks between pieces as line feeds, tabs as spaces.
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x0A if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 0x09 else c for c in range(256))

_BLOCK = "block long, grams long, place binary, code binary, name binary"
_MADE = "block long, words long, langs array<string>, lang binary, size binary, word binary, n binary, place binary, codes binary"
_WORDS_ASKED = "range int, block long, langs array<string>, lang binary, size binary, word binary, n binary, codes binary"
_WORDS_COUNTED = "block long, codes binary, ids binary, id long, lang string, word string, f long"
_ASKED = "range int, block long, a binary, b binary, n binary"
_COUNTED = "block long, range int, kept binary, ids binary, id long, a long, b long, f long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each block's distinct words (with ``code`` and ``n``), and one of its places.

    Columns: block, lang, word, code, n, place, codes. Places of a piece follow each
    other; a place is left out between pieces.
    """
    first, number = TaskContext.get().partitionId() << 33, 0
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            held.append(some)
            size += pc.sum(pc.binary_length(some.column(0))).as_py() or 0
            if size >= BLOCK_BYTES:
                yield from _block(first + number, held)
                held, size, number = [], 0, number + 1
                give_back()
    if held:
        yield from _block(first + number, held)


def _block(block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    texts = [(t or "").encode() for t in table.column(0).to_pylist()]
    langs = pc.fill_null(table.column(1).combine_chunks(), "und").dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw = np.frombuffer(b"\n".join([*texts, b""]).translate(_PLAIN), np.uint8)
    del texts
    solid = (raw != 0x20) & (raw != 0x0A)
    begin = np.flatnonzero(solid & ~np.append(False, solid[:-1]))
    if not len(begin):
        return
    length = np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1 - begin
    offsets = np.append(0, np.cumsum(length))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[solid])]).dictionary_encode()
    piece = np.cumsum(raw == 0x0A)[begin]
    place = np.arange(len(begin)) + np.append(0, np.cumsum(piece[1:] != piece[:-1]))
    own = langs.indices.to_numpy(zero_copy_only=False)[np.searchsorted(ends, begin, "right")]
    del raw, solid, piece, begin, length, offsets
    key = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(langs.dictionary) + own
    keys, code, n = np.unique(key, return_inverse=True, return_counts=True)
    # frequent words get small codes, which are stored in little space
    order = np.argsort(-n, kind="stable")
    code, keys, n = np.argsort(order, kind="stable")[code], keys[order], n[order]
    names = [*"block lang word code n place codes".split()]
    for at in range(0, len(keys), 1 << 16):
        k = keys[at : at + (1 << 16)]
        word = words.dictionary.take(pa.array(k // len(langs.dictionary))).cast(pa.binary()).cast(pa.string())
        lang = langs.dictionary.take(pa.array(k % len(langs.dictionary)))
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(block, pa.int64()), len(k)), lang, word, pa.array(np.arange(at, at + len(k)).astype(np.int32)), pa.array(n[at : at + len(k)].astype(np.int64)), pa.nulls(len(k), pa.binary()), pa.nulls(len(k), pa.binary())], names
        )
    yield pa.RecordBatch.from_arrays(
        [pa.array([block]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([_packed(place)], pa.binary()), pa.array([code.astype(np.int32).tobytes()], pa.binary())], names
    )


def _packed(place: np.ndarray) -> bytes:
    """Rising places as the steps between them."""
    return np.diff(place, prepend=0).astype(np.int32).tobytes()


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.int32).astype(np.int64))


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers from 0 on as the planes of their bytes, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(values).to_bytes(7, "little") + bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _numbers(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:7], "little"), data[7]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<i8")[:, 0]


def _squeezed_rising(values: np.ndarray) -> bytes:
    return _squeezed(np.diff(values, prepend=0))


def _rising(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data))


def _squeezed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block of ``_blocks`` as one row, in little space; its words by their codes."""
    held: list[pa.RecordBatch] = []
    for batch in _blocks(batches):
        held.append(batch)
        place, codes = batch.column(5)[0].as_py(), batch.column(6)[0].as_py()
        if codes is None:
            continue
        table = pa.Table.from_batches(held[:-1]).combine_chunks()
        held = []
        lang = table.column("lang").chunk(0).dictionary_encode()
        raw = table.column("word").chunk(0).cast(pa.large_binary()).to_pylist()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        row = [_squeezed(lang.indices.to_numpy()), _squeezed(sizes), pa.compress(b"".join(raw), "zstd", asbytes=True), _squeezed(table.column("n").to_numpy())]
        row += [_squeezed_rising(_places(place)), _squeezed(np.frombuffer(codes, np.int32))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(raw)], pa.int64()), pa.array([lang.dictionary.to_pylist()], pa.list_(pa.string())), *(pa.array([x], pa.binary()) for x in row)], _names(_MADE)
        )


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _unpacked(size: bytes, word: bytes) -> pa.LargeBinaryArray:
    ends = _rising(size)
    raw = pa.decompress(word, int(ends[-1]), "zstd", asbytes=True)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(raw)])


def _words_asked(ranges: int):
    """Each block's distinct words, a row for each range that has any, by their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, lang, n = _unpacked(row["size"], row["word"]), _numbers(row["lang"]), _numbers(row["n"])
                hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words)) % np.uint64(ranges)
                order = np.argsort(hashed, kind="stable")
                ends = np.searchsorted(hashed[order], np.arange(ranges + 1, dtype=np.uint64))
                raw = words.take(pa.array(order)).to_pylist()
                out: list[tuple] = []
                for k, (i, j) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)):
                    if i < j:
                        own, some = order[i:j], raw[i:j]
                        sizes = np.fromiter(map(len, some), np.int64, len(some))
                        out.append((k, row["block"], row["langs"], _squeezed(lang[own]), _squeezed(sizes), pa.compress(b"".join(some), "zstd", asbytes=True), _squeezed(n[own]), _squeezed_rising(own)))
                types = [pa.int32(), pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], _names(_WORDS_ASKED))
            give_back()

    return run


def _words_counted(least: int):
    """The frequent words of a range with ids of their own, the number of all words of
    each language (without a word), and for each block the codes and ids of its frequent ones."""

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        first, rows = key[0].as_py() << 32, asked.to_pylist()
        langs = sorted({x for r in rows for x in r["langs"]})
        place = {x: i for i, x in enumerate(langs)}
        lang = np.concatenate([np.array([place[x] for x in r["langs"]])[_numbers(r["lang"])] for r in rows])
        n = np.concatenate([_numbers(r["n"]) for r in rows])
        words = pa.concat_arrays([_unpacked(r["size"], r["word"]) for r in rows]).dictionary_encode()
        keys, of = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(langs) + lang, return_inverse=True)
        # exact up to 2^53 occurrences
        f = np.bincount(of, n, len(keys)).astype(np.int64)
        often = f >= least
        found = np.where(often, np.cumsum(often) - 1, -1)[of]
        codes = [_rising(r["codes"]) for r in rows]
        answers = [(r["block"], c[own >= 0], own[own >= 0]) for r, c, own in zip(rows, codes, np.split(found, np.cumsum([len(c) for c in codes])[:-1]), strict=True)]
        answers = [(block, _squeezed_rising(c), _squeezed(first + own)) for block, c, own in answers if len(own)]
        own, total = keys[often], np.bincount(lang, n, len(langs)).astype(np.int64)
        names = words.dictionary.take(pa.array(own // len(langs))).cast(pa.binary()).cast(pa.string())
        no = lambda k, *types: [pa.nulls(k, t) for t in types]
        long, raw, text = pa.int64(), pa.binary(), pa.string()
        return pa.concat_tables(
            [
                pa.table([*(pa.array([r[i] for r in answers], t) for i, t in enumerate((long, raw, raw))), *no(len(answers), long, text, text, long)], _names(_WORDS_COUNTED)),
                pa.table([*no(len(own), long, raw, raw), pa.array(first + np.arange(len(own))), pa.array([langs[i] for i in own % len(langs)], text), names, pa.array(f[often])], _names(_WORDS_COUNTED)),
                pa.table([*no(len(langs), long, raw, raw, long), pa.array(langs, text), *no(len(langs), text), pa.array(total)], _names(_WORDS_COUNTED)),
            ]
        )

    return run


_NO_BLOCK = pa.table({"block": pa.array([], pa.int64()), "grams": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("place", "code", "name")}})


def _renamed(block: int, place: np.ndarray, name: np.ndarray) -> pa.Table:
    names, code = np.unique(name, return_inverse=True)
    row = {"block": pa.array([block], pa.int64()), "grams": pa.array([len(place)], pa.int64())}
    row |= {c: pa.array([v], pa.binary()) for c, v in (("place", _squeezed_rising(place)), ("code", _squeezed(code)), ("name", _squeezed_rising(names)))}
    return pa.table(row)


def _words_named(key: tuple, block: pa.Table, named: pa.Table) -> pa.Table:
    """A block's places that have frequent words, with the words' ids."""
    if not block.num_rows or not named.num_rows:
        return _NO_BLOCK
    code = _numbers(block.column("codes")[0].as_py())
    ids = np.full(int(code.max()) + 1, -1, np.int64)
    for row in named.to_pylist():
        ids[_rising(row["codes"])] = _numbers(row["ids"])
    name = ids[code]
    kept = name >= 0
    return _renamed(key[0].as_py(), _rising(block.column("place")[0].as_py())[kept], name[kept])


class _Pairs:
    """A block's pairs of adjacent grams: the first one's ``place`` and the number ``of``
    its distinct pair, and of each distinct pair a, b, ``n``; by a and b, and dealt to ranges."""

    def __init__(self, place: bytes, code: bytes, name: bytes, ranges: int):
        places, codes, names = _rising(place), _numbers(code), _rising(name)
        next_to = np.flatnonzero(places[1:] == places[:-1] + 1)
        self.place = places[next_to]
        keys, self.of, self.n = np.unique(codes[next_to] * len(names) + codes[next_to + 1], return_inverse=True, return_counts=True)
        self.a, self.b = names[keys // max(1, len(names))], names[keys % max(1, len(names))]
        hashed = mix(mix(self.a.astype(np.uint64)) + self.b.astype(np.uint64)) % np.uint64(ranges)
        self.order = np.argsort(hashed, kind="stable")
        self.ends = np.searchsorted(hashed[self.order], np.arange(ranges + 1, dtype=np.uint64))

    def range(self, k: int) -> np.ndarray:
        """The distinct pairs of a range, by a and b."""
        return self.order[self.ends[k] : self.ends[k + 1]]


def _asked(ranges: int):
    """Each block's distinct pairs, a row for each range that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = _Pairs(row["place"], row["code"], row["name"], ranges)
                some = [k for k in range(ranges) if pairs.ends[k] < pairs.ends[k + 1]]
                own = [pairs.range(k) for k in some]
                packed = ([_squeezed_rising(pairs.a[i]) for i in own], [_squeezed(pairs.b[i]) for i in own], [_squeezed(pairs.n[i]) for i in own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.repeat(pa.scalar(row["block"], pa.int64()), len(some)), *(pa.array(c, pa.binary()) for c in packed)], ["range", "block", "a", "b", "n"]
                )
            give_back()

    return run


def _counted(least: int):
    """The frequent pairs of a range with ids of their own, and for each block that has
    any of them which of its pairs they are, and their ids."""

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        first = key[0].as_py() << 32
        a = [_rising(x) for x in asked.column("a").to_pylist()]
        ends = np.cumsum([len(x) for x in a])
        a, b, n = np.concatenate(a), *(np.concatenate([_numbers(x) for x in asked.column(c).to_pylist()]) for c in "bn")
        order = np.lexsort((b, a))
        new = np.append(True, (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]))
        start = np.flatnonzero(new)
        f = np.add.reduceat(n[order], start)
        often = f >= least
        ids = np.where(often, np.cumsum(often) - 1, -1)
        found = np.empty(len(a), np.int64)
        found[order] = ids[np.cumsum(new) - 1]
        rows = [(block, own >= 0, own[own >= 0]) for block, own in zip(asked.column("block").to_pylist(), np.split(found, ends[:-1]), strict=True)]
        rows = [(block, _squeezed(np.packbits(kept)), _squeezed_rising(own)) for block, kept, own in rows if len(own)]
        at, some = order[start[often]], int(often.sum())
        answers = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]
        no = lambda k, *types: [pa.nulls(k, t) for t in types]
        long, raw = pa.int64(), pa.binary()
        names = _names(_COUNTED)
        return pa.concat_tables(
            [
                pa.table([answers[0], pa.repeat(pa.scalar(key[0].as_py(), pa.int32()), len(rows)), *answers[1:], *no(len(rows), long, long, long, long)], names),
                pa.table([*no(some, long, pa.int32(), raw, raw), pa.array(first + np.arange(some)), pa.array(a[at]), pa.array(b[at]), pa.array(f[often])], names),
            ]
        )

    return run


def _pairs_named(ranges: int):
    """A block's places that begin frequent pairs, with the pairs' ids."""

    def run(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows or not answers.num_rows:
            return _NO_BLOCK
        pairs = _Pairs(*(block.column(c)[0].as_py() for c in ("place", "code", "name")), ranges)
        ids = np.full(len(pairs.a), -1, np.int64)
        for row in answers.to_pylist():
            own = pairs.range(row["range"])
            kept = np.unpackbits(_numbers(row["kept"]).astype(np.uint8), count=len(own)).astype(bool)
            ids[own[kept]] = (row["range"] << 32) + _rising(row["ids"])
        name = ids[pairs.of]
        kept = name >= 0
        return _renamed(key[0].as_py(), pairs.place[kept], name[kept])

    return run


def _ranges(blocks: DataFrame, held: str, most: int) -> int:
    """How many ranges the words or grams that blocks hold are dealt to, ``most`` to each."""
    return max(LEAST_RANGES, -(-(blocks.agg(F.sum(held)).first()[0] or 0) // most))


def _longer(pairs: DataFrame, below: DataFrame) -> DataFrame:
    """Phrases of named pairs (id, a, b, f): id, a, b, lang, phrase, last word, f, and the
    counts of what they begin and end with, the shortest first."""
    one = below.select(F.col("id").alias("a"), "lang", "phrase", F.concat("begins", F.array("f")).alias("begins"))
    two = below.select(F.col("id").alias("b"), "last", F.concat("ends", F.array("f")).alias("ends"))
    met = pairs.join(one, "a").join(two, "b")
    return met.select("id", "a", "b", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "begins", "ends")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)), in 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    over = (wide(a) * wide(n)).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")).cast("long")


def _first(ranked: DataFrame, most: int) -> DataFrame:
    """Each language's first phrases, with ranks: first of each part of them, then of all."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = Window.partitionBy("lang", "part").orderBy(*order)
    some = ranked.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, most: int = 2000) -> DataFrame:
    """Each language's first ``most`` phrases: lang, rank, phrase, a, l, r, n, score.

    Phrases have 2 to ``longest`` words (A-Z lower-cased, between spaces and tabs, within
    pieces between ``.,;:!?`` and line ends) and occur ``a`` >= ``least`` times in their
    language, which has ``n`` words. The score is the least of a phrase's cuts into two
    parts, which occur ``l`` and ``r`` times; of equal ones the first cut counts. Phrases
    within a longer one that is as frequent are left out. Reads text and lang: a null
    lang is ``und``, null and empty texts have no words, repeated rows count each, an
    empty table gives an empty result. Other columns are not read.
    """
    return passing(lambda: _collocations(docs, longest, least, most))


def _collocations(docs: DataFrame, longest: int, least: int, most: int) -> DataFrame:
    source = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    made = written(source.mapInArrow(_squeezed_blocks, _MADE), "blocks", "zstd")
    asked = made.drop("words", "place", "codes").mapInArrow(_words_asked(_ranges(made, "words", WORDS_A_RANGE)), _WORDS_ASKED)
    counted = written(asked.groupBy("range").applyInArrow(_words_counted(least), _WORDS_COUNTED), "words", "zstd")
    total = counted.where("block is null and word is null").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counted.where("word is not null").select("id", "lang", "word", "f")
    answers = counted.where("block is not null").select(F.col("block").alias("of"), "codes", "ids")
    places = made.select("block", "place", "codes")
    blocks = written(places.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_words_named, _BLOCK), "places", "zstd")
    drop_written(made)
    level = frequent.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array().cast("array<long>").alias("begins"), F.array().cast("array<long>").alias("ends"))
    levels = []
    for k in range(2, longest + 1):
        ranges = _ranges(blocks, "grams", GRAMS_A_RANGE)
        asked = blocks.mapInArrow(_asked(ranges), _ASKED)
        counted = written(asked.groupBy("range").applyInArrow(_counted(least), _COUNTED), "counted", "zstd")
        level = written(_longer(counted.where("block is null").select("id", "a", "b", "f"), level), "level")
        levels.append(level)
        if k < longest:
            answers = counted.where("block is not null").select(F.col("block").alias("of"), "range", "kept", "ids")
            after = written(blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_pairs_named(ranges), _BLOCK), "places", "zstd")
            drop_written(blocks, counted)
            blocks = after
    found = []
    for k, level in enumerate(levels, 2):
        own = level
        if k < longest:
            above = levels[k - 1]
            inside = above.select(F.col("a").alias("id"), "f").union(above.select("b", "f")).distinct()
            own = own.join(inside, ["id", "f"], "left_anti")
        cuts = F.array(*(F.struct(F.lit(j).alias("j"), F.col("begins")[j - 1].alias("l"), F.col("ends")[k - j - 1].alias("r")) for j in range(1, k)))
        found.append(own.select("lang", "phrase", F.col("f").alias("a"), cuts.alias("cuts")))
    every = found[0]
    for other in found[1:]:
        every = every.union(other)
    every = every.join(written(total, "total"), "lang")
    scored = F.transform("cuts", lambda c: F.struct(_score(F.col("a"), F.col("n"), c["l"], c["r"]).alias("score"), c["j"].alias("j"), c["l"].alias("l"), c["r"].alias("r")))
    ranked = every.withColumn("best", F.array_min(scored)).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    return _first(ranked, most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
