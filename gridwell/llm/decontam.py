"""Benchmark decontamination by suffix arrays of the training texts.

Each batch of documents is a shard. Its words become numbers (words that no test
item has are 0), its suffixes that could match anything are sorted into a suffix
array by their first ``WINDOW`` words, and every test suffix is found in it by
binary search: the equal range holds all places where that window occurs. Each
occurrence is then extended against the sorted test suffixes to the longest
verbatim match.

The test set is taken in blocks of a bounded number of words, each broadcast; a
document's hits are carried from block to block. After ``BLOCKS_IN_A_STAGE`` blocks a
stage ends: of a longer test set each stage reads the texts again and writes hits alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwell.llm.text import alnum_words, pieces
from gridwell.session import written

WINDOW = 10
BLOCK_WORDS = 1 << 20
BLOCKS_IN_A_STAGE = 4
#: Documents in a shard at most; Spark bounds the bytes of a batch.
SHARD_ROWS = 1024


class Tests:
    """A block of test items: vocabulary, numbered words, sorted windows, sorted suffixes."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        coded = [np.array([number.setdefault(w, len(number) + 1) for w in words], np.uint32) for _, words in items]
        self.names = [name for name, _ in items]
        self.words = np.concatenate([np.append(c, 0) for c in coded] or [np.zeros(0)]).astype(np.uint32)
        self.owner = np.repeat(np.arange(len(coded)), [len(c) + 1 for c in coded])
        starts, lengths, owners = [], [], []
        at = 0
        for i, c in enumerate(coded):
            if len(c):
                size = min(window, len(c))
                for p in range(len(c) - size + 1):
                    starts.append(at + p)
                    lengths.append(size)
                    owners.append(i)
            at += len(c) + 1
        lengths = np.array(lengths, np.int64)
        keys = _keys(self.words, np.array(starts, np.int64), window, lengths)
        self.shortest = int(lengths.min()) if len(lengths) else 0
        self.low, index = np.unique(keys, return_inverse=True)
        self.length = np.zeros(len(self.low), np.int64)
        self.length[index] = lengths
        raw = self.low.astype(f"S{4 * window}").view(np.uint8).reshape(len(self.low), 4 * window).copy()
        raw[np.arange(4 * window)[None, :] >= 4 * self.length[:, None]] = 255
        self.high = raw.reshape(-1).view(f"S{4 * window}")
        order = np.lexsort((owners, index))
        self.item = np.array(owners, np.int64)[order]
        self.item_from = np.searchsorted(index[order], np.arange(len(self.low) + 1))
        pair = self.words[:-1].astype(np.int64) << 32 | self.words[1:]
        self.pairs = np.unique(pair)
        self.order = self._sorted_suffixes()

    def _sorted_suffixes(self) -> np.ndarray:
        """All suffixes of the test words in order, by doubling the compared length."""
        n = len(self.words)
        rank = self.words.astype(np.int64)
        step = 1
        while n:
            later = np.append(rank[step:], np.zeros(min(step, n), np.int64))[:n]
            order = np.lexsort((later, rank))
            fresh = (np.diff(rank[order]) != 0) | (np.diff(later[order]) != 0)
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[1], 1 + np.cumsum(fresh)])
            if new.max() == n or step > n:
                return order
            rank, step = new, 2 * step
        return np.zeros(0, np.int64)

    def longest(self, words: np.ndarray) -> tuple[int, int]:
        """Length of the longest test text that ``words`` starts with, and its item."""
        lo, hi = 0, len(self.order)
        best, place = 0, 0
        while lo < hi:
            mid = (lo + hi) // 2
            q = self.order[mid]
            n = min(len(words), len(self.words) - q)
            same = _alike(self.words[q : q + n], words[:n])
            if same > best:
                best, place = same, q
            if same == len(words):
                break
            if same == n or self.words[q + same] < words[same]:
                lo = mid + 1
            else:
                hi = mid
        return best, int(self.owner[place])


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two runs of one length start with in common, found in doubling blocks."""
    at, size = 0, 16
    while at < len(a):
        differ = a[at : at + size] != b[at : at + size]
        if differ.any():
            return at + int(differ.argmax())
        at, size = at + size, 2 * size
    return len(a)


def _keys(words: np.ndarray, starts: np.ndarray, window: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """Byte strings that order suffixes by their first ``window`` words."""
    padded = np.append(words, np.zeros(window, np.uint32))
    block = padded[starts[:, None] + np.arange(window)] if len(starts) else np.zeros((0, window), np.uint32)
    if lengths is not None:
        block = np.where(np.arange(window) < lengths[:, None], block, 0)
    return np.ascontiguousarray(block.astype(">u4")).view(np.uint8).reshape(len(starts), 4 * window).reshape(-1).view(f"S{4 * window}")


class _Shard:
    """The suffix array of one batch of documents, and the test windows found in it."""

    def __init__(self, tests: Tests, texts: list[str | None]):
        get = tests.vocabulary.get
        coded = []
        for text in texts:
            words = alnum_words(text)
            coded.append(np.fromiter(map(get, words, repeat(0)), np.uint32, len(words)))
        self.sizes = np.array([len(c) for c in coded], np.int64)
        # a 0 after each document: no match crosses it
        self.words = np.concatenate([np.append(c, 0) for c in coded]).astype(np.uint32)
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1
        places = self._candidates(tests)
        keys = _keys(self.words, places, tests.window)
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        lo, hi = np.searchsorted(keys, tests.low, "left"), np.searchsorted(keys, tests.high, "right")
        found = np.flatnonzero(hi > lo)
        counts = (hi - lo)[found]
        ranks = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[found], counts)
        self.window_of = np.repeat(found, counts)
        self.place = places[ranks]
        self.doc = np.searchsorted(self.first, self.place, "right") - 1

    def _candidates(self, tests: Tests) -> np.ndarray:
        """Places from which at least the shortest window's number of test words follow,
        the first two of them in that order somewhere in the tests."""
        need = tests.shortest
        if not need or len(self.words) < need:
            return np.zeros(0, np.int64)
        unknown = np.concatenate([[0], np.cumsum(self.words == 0)])
        places = np.flatnonzero(unknown[need:] == unknown[:-need])
        if need > 1 and len(places):
            pair = self.words[places].astype(np.int64) << 32 | self.words[places + 1]
            at = np.minimum(np.searchsorted(tests.pairs, pair), len(tests.pairs) - 1)
            places = places[tests.pairs[at] == pair]
        return places


_STATE = [
    ("n_words", T.LongType()),
    ("hits", T.BinaryType()),
    ("items", T.ArrayType(T.StringType())),
    ("longest", T.LongType()),
    ("longest_start", T.LongType()),
    ("longest_item", T.StringType()),
]


def _search(tests, text_at: int, width: int, names: list[str]):
    """Adds a block's hits to the state columns, which are the last of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Tests = tests.value
        for batch in pieces(batches, SHARD_ROWS):
            if not batch.num_rows:
                continue
            shard = _Shard(block, batch.column(text_at).to_pylist())
            state = [c.to_pylist() for c in batch.columns[width:]]
            order = np.argsort(shard.doc, kind="stable")
            doc, place, window = shard.doc[order], shard.place[order], shard.window_of[order]
            for i, (a, b) in enumerate(zip(np.searchsorted(doc, np.arange(batch.num_rows)), np.searchsorted(doc, np.arange(batch.num_rows), "right"), strict=True)):
                n = int(shard.sizes[i])
                state[0][i] = n
                if a == b:
                    continue
                first = shard.first[i]
                starts = place[a:b] - first
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + block.length[window[a:b]], -1)
                hit = np.cumsum(edge[:-1]) > 0
                if state[1][i] is not None:
                    hit |= np.unpackbits(np.frombuffer(state[1][i], np.uint8), count=n).astype(bool)
                state[1][i] = np.packbits(hit).tobytes()
                seen = np.unique(window[a:b])
                owners = np.unique(np.concatenate([block.item[block.item_from[w] : block.item_from[w + 1]] for w in seen]))
                named = {block.names[o] for o in owners} - {None}
                state[2][i] = sorted(named.union(state[2][i] or ()))
                text = shard.words[first : first + n]
                length, start, owner = _longest(block, text, np.unique(starts), _run_ends(hit), state[3][i] or 0)
                if owner is not None:
                    state[3][i], state[4][i], state[5][i] = length, start, block.names[owner]
            types = [pa.int64(), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(s, t) for s, t in zip(state, types, strict=True))], names)

    return run


def _longest(block: Tests, text: np.ndarray, starts: np.ndarray, end: np.ndarray, best: int) -> tuple[int, int, int | None]:
    """The first of the longest matches from ``starts`` that is longer than ``best``: length,
    start and item, none if there is no such match. Matches lie within runs of hit words."""
    found = best, 0, None
    k = 0
    while k < len(starts):
        s = int(starts[k])
        stop = int(end[s])
        if stop - s <= found[0]:
            k = int(np.searchsorted(starts, stop))
            continue
        length, owner = block.longest(text[s:stop])
        if length > found[0]:
            found = length, s, owner
        # a longer match from a later place takes in the word that ended this one: the
        # first such place is searched for, since what starts later occurs all the more
        reach = s + length + 1
        low, high = s + 1, min(reach, stop)
        if reach > stop:
            low = stop
        while low < high:
            mid = (low + high) // 2
            if block.longest(text[mid:reach])[0] == reach - mid:
                high = mid
            else:
                low = mid + 1
        k = int(np.searchsorted(starts, max(low, s + 1)))
    return found


def _run_ends(hit: np.ndarray) -> np.ndarray:
    """For each hit word where its run of hit words ends."""
    stops = np.append(np.flatnonzero(~hit), len(hit))
    return stops[np.searchsorted(stops, np.arange(len(hit)))]


def _blocks(items: DataFrame, most: int) -> Iterator[Tests]:
    """Test items in blocks of at most ``most`` words, or of one longer item."""
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = alnum_words(row[1])
        if words:
            if held and size + len(words) > most:
                yield Tests(held)
                held, size = [], 0
            held.append((row[0], words))
            size += len(words)
    if held:
        yield Tests(held)


def _stage(docs: DataFrame, blocks: list[Tests], text_at: int) -> DataFrame:
    """``docs`` and the state columns, after a search for all of ``blocks`` in one pass."""
    width = len(docs.columns)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    for name, kind in _STATE:
        docs = docs.withColumn(name, F.lit(None).cast(kind))
        schema = schema.add(name, kind)
    for block in blocks:
        docs = docs.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(block), text_at, width, schema.names), schema)
    return docs


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's lists of packed bits as the bits that any of a list has."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1).to_pylist()
        bits = [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in some]).tobytes() if some else None for some in lists]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bits, pa.binary())], batch.schema.names)


def _in_stages(docs: DataFrame, stages: Iterator[list[Tests]], text_at: int) -> DataFrame:
    """As :func:`_stage` over stages of blocks. Texts are written once; a stage reads them
    and writes the rows' ids and what it found, and what all found is joined to the texts."""
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    own = docs.columns[text_at]
    found = None
    for k, blocks in enumerate(stages):
        state = _stage(rows.select("row", own), blocks, 1).drop(own).withColumn("stage", F.lit(k))
        state = written(state if not k else state.where("hits is not null"), "matches")
        found = state if found is None else found.unionByName(state)
    # of equally long matches that of the earliest stage counts
    best = F.max(F.when(F.col("longest").isNotNull(), F.struct("longest", (-F.col("stage")).alias("earliest"), "longest_start", "longest_item")))
    merged = found.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), best.alias("best"), F.collect_list("hits").alias("hits")
    )
    items = F.when(F.size("hits") > 0, F.array_sort(F.array_distinct("items"))).alias("items")
    flat = merged.select("row", "n_words", items, *(F.col(f"best.{c}").alias(c) for c in ("longest", "longest_start", "longest_item")), "hits")
    kinds = dict(_STATE)
    schema = "row long, " + ", ".join(f"{c} {kinds[c].simpleString()}" for c in flat.columns[1:-1]) + ", hits binary"
    # both sides grow with the documents; merged, rows keep their order within a partition
    return rows.hint("merge").join(flat.mapInArrow(_either, schema), "row").select(*docs.columns, *kinds)


def search(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (any columns with ``text``) and, as the struct ``match``: n_words, hits
    (packed bits of its words), items (sorted ids of items with windows in it), and
    longest, longest_start, longest_item of its longest verbatim match.

    A document or item without words, null or empty, matches nothing. An item with a
    null id is searched for but not listed; items that repeat an id count once.
    """
    columns = docs.columns
    inner = [f"c{i}" for i in range(len(columns))]
    text_at = columns.index("text")
    blocks = _blocks(items, block_words)
    stages = iter(lambda: list(islice(blocks, BLOCKS_IN_A_STAGE)), [])
    first = next(stages, [Tests([])])
    second = next(stages, None)
    now = docs.toDF(*inner)
    now = _stage(now, first, text_at) if second is None else _in_stages(now, chain([first, second], stages), text_at)
    match = F.struct(*(F.col(name) for name, _ in _STATE)).alias("match")
    return now.select(*(F.col(i).alias(c) for i, c in zip(inner, columns, strict=True)), match)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, longest, longest_start, longest_item."""
    match = search(docs.select("doc_id", "text"), items).select("doc_id", "match.*")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            hits = [0 if b is None else int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in batch.column(2).to_pylist()]
            items = [x or [] for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(hits, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    pa.array([h > 0 for h in hits], pa.bool_()),
                    *batch.columns[4:],
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_start", "longest_item"],
            )

    return match.mapInArrow(
        counted,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_start long, longest_item string",
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs, columns unchanged, whatever their names."""
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    found = search(docs.toDF(*names), items).where(F.col("match.hits").isNull())
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
