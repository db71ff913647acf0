"""Log-bilinear language model, trained with noise-contrastive estimation in numpy.

The vector of the last word and that of the state of the words before, each through a
matrix of its place, add up to a prediction; its product with a word's vector, plus the
word's bias, is the word's score. The ``TARGETS`` most frequent words have vectors of
their own. All others share those of buckets, whose number grows with the distinct
words, and are told apart within one by their counts; a word's bucket follows from its
class and hash. So every word is both a context and a target. The normaliser of each
pair of contexts is found once, by batched matrix products over all targets, and every
log-probability is exactly normalised.

Classes are groups of the ``TELLING`` most frequent words that share documents, found
from the number of documents with both words of each pair, over all training documents.
The state of a place says which class the last ``NEAR`` words speak for, and whether few
or many of them do. A less frequent word's class is the one whose states it stands in
most often; words beyond the ``HEAD`` most frequent have a class of their own.

What is learned covers all training documents. They are dealt by hashes to as many
shards as their tokens need; in each of ``ROUNDS`` rounds every shard trains from common
parameters on its own share, and the results are averaged in a tree, weighted by tokens.
Neither the classes nor the parameters depend on how the input is partitioned.

Only the head is sent to executors. The rest of a document's words are joined with the
table of counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gridwell.llm.text import ROWS_PER_PIECE, distinct_space_words, pieces, pieces_by_size
from gridwell.session import drop_written, written

HEAD = 1 << 18
TARGETS = 4095
WIDTH = 24
ROUNDS = 2
PASSES = 1
BATCH = 256
NOISE = 64
DRAWN_AT_ONCE = 256
#: Frequent words that tell classes, number of classes, words back that count, and
#: telling words among them from which on they are many.
TELLING = 256
CLASSES = 15
NEAR = 64
MANY = 4
STATES = 1 + 2 * CLASSES
#: Distinct words for each bucket, at least.
WORDS_A_BUCKET = 512
#: Noise samples that a token counts for.
RATIO = 25.0
RATE = 0.05
FAN_IN = 16
BLOCK = 1 << 20
COUNTED_AT_ONCE = 1 << 20
TOKENS_A_SHARD = 1 << 21
TOKENS_AT_ONCE = 1 << 16
#: Words whose normalisers are found at once, and by a task.
WORDS_AT_ONCE = 128
WORDS_A_TASK = 1024
#: Sums of products from which on what underflows doesn't count.
LEAST_SUM = 1e-250
SMOOTH = 0.1
END = b""

_FLAT = "part int, block int, tokens double, flat binary"


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _hashes(words: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) ^ np.uint64(1 << 63)).view(np.int64)


def training(doc_id: Column) -> Column:
    """Whether a document is learned from: by the CRC-32 of its id as text; null is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) != 0, F.lit(False))


def held_out(doc_id: int | str | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): hash and count of every training token, over all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in pieces_by_size(batches, 0):
            words, codes, sizes = distinct_space_words(batch.column(0))
            n = np.bincount(codes, minlength=len(words)).astype(np.int64)
            held.append((np.append(_hashes(words), _hash(END)), np.append(n, len(sizes))))
            size += len(words) + 1
            if size >= COUNTED_AT_ONCE:
                yield _counted(held)
                held, size = [], 0
        if held:
            yield _counted(held)

    texts = docs.where(training(F.col("doc_id"))).select(F.col("text").cast("string"))
    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    h, index = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
    c = np.bincount(index, np.concatenate([n for _, n in held])).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], ["h", "c"])


@dataclass
class Vocabulary:
    """The head's hashes by falling count, their counts, and totals over all words."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    #: Buckets of each class.
    buckets: int
    #: For each class's buckets the counts and numbers of the words beyond the head.
    tail: np.ndarray
    #: For each word of the head its class; of targets it is not used.
    classes: np.ndarray | None = None
    #: For each telling word what it says for each class, in 1024ths, and 1.
    says: np.ndarray | None = None

    @property
    def targets(self) -> int:
        return min(TARGETS, len(self.hashes))

    @property
    def size(self) -> int:
        """Targets and buckets."""
        return self.targets + (CLASSES + 1) * self.buckets

    @property
    def total(self) -> float:
        return self.tokens + SMOOTH * (self.distinct + 1)

    def index(self) -> np.ndarray:
        """The target or bucket of each of ``codes``."""
        t = self.targets
        own = t + self.classes[t:] * self.buckets + (self.hashes[t:] & (self.buckets - 1))
        return np.concatenate([np.arange(t), own, t + CLASSES * self.buckets + np.arange(self.buckets)])

    def masses(self) -> np.ndarray:
        """For each target and bucket the weight of its words, in a bucket an unseen one included."""
        index = self.index()[: len(self.hashes)]
        out = np.bincount(index, self.counts + SMOOTH, self.size).astype(float)
        out[self.targets :] += SMOOTH
        out[self.size - self.buckets :] += self.tail[0] + SMOOTH * self.tail[1]
        return out

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words in the head, or the head's size plus the bucket of their hash."""
        head = len(self.hashes)
        out = head + (hashes & (self.buckets - 1))
        if head:
            order = np.argsort(self.hashes)
            at = order[np.minimum(np.searchsorted(self.hashes, hashes, sorter=order), head - 1)]
            found = self.hashes[at] == hashes
            out[found] = at[found]
        return out.astype(np.int32)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The words of the ``HEAD`` highest counts; of a count that not all fit in none."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # there are at most as many different counts as the root of twice the tokens
    by_count = counts.groupBy("c").count().toPandas().sort_values("c", ascending=False)
    fits = np.cumsum(by_count["count"].to_numpy(np.int64)) <= HEAD
    least = int(by_count["c"].to_numpy(np.int64)[fits].min()) if fits.any() else 1 << 62
    head = counts.where(F.col("c") >= least).toPandas().sort_values(["c", "h"], ascending=[False, True])
    buckets = 1 << max(0, (distinct // (WORDS_A_BUCKET * (CLASSES + 1))).bit_length())
    rest = counts.where(F.col("c") < least).groupBy(F.col("h").bitwiseAND(F.lit(buckets - 1)).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toPandas()
    tail = np.zeros((2, buckets))
    tail[:, rest["b"].to_numpy(np.int64)] = rest["c"].to_numpy(float), rest["n"].to_numpy(float)
    return Vocabulary(head["h"].to_numpy(np.int64), head["c"].to_numpy(np.int64), int(tokens), int(distinct), buckets, tail)


def _coded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Each document's codes (little-endian 32-bit) and its words beyond the head, and
    for each partition the numbers of training documents with two telling words."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kind = "string" if docs.schema["doc_id"].dataType.simpleString() == "string" else "bigint"
    arrow = _coded_arrow(pa.string() if kind == "string" else pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, head = shared.value, len(shared.value.hashes)
        part = TaskContext.get().partitionId()
        row = part << 40
        end = known.codes(_hashes([END]))
        both = np.zeros((TELLING, TELLING), np.float64)
        for batch in pieces_by_size(batches, 1):
            words, place, sizes = distinct_space_words(batch.column(1))
            hashes = np.append(_hashes(words), _hash(END))
            codes = np.append(known.codes(hashes[:-1]), end)
            # the end token follows each text
            whole = np.full(len(place) + len(sizes), len(words), np.int32)
            last = np.cumsum(sizes + 1) - 1
            own = np.ones(len(whole), bool)
            own[last] = False
            whole[own] = place
            for a in range(0, batch.num_rows, ROWS_PER_PIECE):
                ids = batch.column(0)[a : a + ROWS_PER_PIECE].to_pylist()
                seen = np.zeros((len(ids), TELLING), np.float32)
                rows: list[tuple] = []
                for k, i in enumerate(ids):
                    z = whole[last[a + k] - sizes[a + k] : last[a + k] + 1]
                    c = codes[z]
                    tail, n = np.unique(hashes[z[c >= head]], return_counts=True)
                    held = held_out(i)
                    if not held:
                        seen[k, c[c < TELLING]] = 1
                    raw = c.tobytes()
                    rows.append((row, i, held, len(c), zlib.crc32(raw), raw, tail, n.astype(np.int64), None))
                    row += 1
                both += seen.T @ seen
                yield _rows(rows, arrow)
        yield _rows([(-1 - part, None, None, 0, 0, None, [], [], both.tobytes())], arrow)

    return docs.mapInArrow(run, _CODED.format(kind))


_CODED = "row long, doc_id {}, held_out boolean, n_tokens long, crc long, codes binary, tail_h array<long>, tail_n array<long>, both binary"


def _coded_arrow(kind: pa.DataType) -> pa.Schema:
    return pa.schema(
        [("row", pa.int64()), ("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("crc", pa.int64()), ("codes", pa.binary())]
        + [("tail_h", pa.list_(pa.int64())), ("tail_n", pa.list_(pa.int64())), ("both", pa.binary())]
    )


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def classes_of(both: np.ndarray) -> np.ndarray:
    """What each telling word says for each class, from the numbers of documents with
    both words of each pair.

    The rows of the leading eigenvectors of their cosines are grouped around centres,
    the first of which is the most frequent word's and each further one the farthest
    from all before; a word speaks for a class as much as its documents have its words.
    """
    each = np.diag(both)
    n = int((each > 0).sum())
    if not n:
        return np.zeros((TELLING, CLASSES))
    used = np.flatnonzero(each > 0)
    pairs = both[np.ix_(used, used)]
    cosine = pairs / np.sqrt(np.outer(each[used], each[used]))
    value, vector = np.linalg.eigh(cosine)
    top = vector[:, np.argsort(-value)[:CLASSES]]
    top /= np.maximum(np.linalg.norm(top, axis=1, keepdims=True), 1e-12)
    chosen = [int(each[used].argmax())]
    while len(chosen) < min(CLASSES, n):
        near = (top @ top[chosen].T).max(1)
        near[chosen] = np.inf
        chosen.append(int(near.argmin()))
    centres = top[chosen]
    for _ in range(20):
        group = (top @ centres.T).argmax(1)
        for k in range(len(centres)):
            if (group == k).any():
                mean = top[group == k].mean(0)
                centres[k] = mean / max(np.linalg.norm(mean), 1e-12)
    alone = pairs - np.diag(each[used])
    weight = np.stack([alone[:, group == k].sum(1) for k in range(CLASSES)], 1) + 1.0
    share = weight / weight.sum(0)
    says = np.zeros((TELLING, CLASSES))
    says[used] = np.log(share) - np.log(share.mean(1, keepdims=True))
    says[:, len(centres) :] = -8
    return np.clip(says, -8, 8)


def states(codes: np.ndarray, sizes: np.ndarray, says: np.ndarray) -> np.ndarray:
    """For each token of texts the state of those before it in its text: 0 without a
    telling word among the last ``NEAR``, else by their class and whether they are many."""
    out = np.zeros(len(codes), np.int32)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns = np.ascontiguousarray(says.T)
    for a in range(0, len(codes), TOKENS_AT_ONCE):
        b, low = min(a + TOKENS_AT_ONCE, len(codes)), max(0, a - NEAR)
        told = np.minimum(codes[low:b], TELLING).astype(np.int64)
        first = np.maximum(start[a:b], np.arange(a, b) - NEAR) - low
        run = np.zeros(b - low + 1, np.int32)

        def near(k: int, told=told, first=first, run=run, at=a - low) -> np.ndarray:
            np.cumsum(columns[k].take(told, mode="clip"), out=run[1:])
            return run[at:-1] - run.take(first, mode="clip")

        # class by class: each column of a run is small enough for a cache (no index is
        # outside; without clipping take is four times as slow)
        most, best = near(0), np.zeros(b - a, np.int32)
        for k in range(1, CLASSES):
            found = near(k)
            np.copyto(best, k, where=found > most)
            np.maximum(most, found, out=most)
        many = near(CLASSES)
        out[a:b] = np.where(many > 0, 1 + 2 * best + (many >= MANY), 0)
    return out


def _says(classes: np.ndarray) -> np.ndarray:
    """``classes_of`` in 1024ths, with a column of ones, and a row of zeros for all other words."""
    own = np.concatenate([np.rint(1024 * classes), np.ones((TELLING, 1))], 1)
    return np.concatenate([own, np.zeros((1, CLASSES + 1))]).astype(np.int32)


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with all their codes and their numbers of tokens."""
    for batch in pieces(batches):
        raw = batch.column(column).to_pylist()
        yield batch, np.frombuffer(b"".join(raw), "<i4"), np.array([len(r) // 4 for r in raw], np.int64)


def _classified(coded: DataFrame, words: Vocabulary) -> np.ndarray:
    """For each word of the head the class that it stands in most often, over all training documents."""
    shared = coded.sparkSession.sparkContext.broadcast(words.says)
    first, head = words.targets, len(words.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, sizes in _batches(batches, 0):
            state = states(codes, sizes, shared.value)
            own = (state > 0) & (codes >= first) & (codes < head)
            key, n = np.unique(codes[own].astype(np.int64) * CLASSES + (state[own] - 1) // 2, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    counts = coded.where("not held_out").select("codes").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    key = F.col("key")
    best = counts.groupBy(F.floor(key / CLASSES).alias("code")).agg(F.max(F.struct("n", (-F.pmod(key, F.lit(CLASSES))).alias("k"))).alias("top"))
    found = best.select("code", (-F.col("top.k")).alias("k")).toPandas()
    out = np.full(head, CLASSES, np.int64)
    out[found["code"].to_numpy(np.int64)] = found["k"].to_numpy(np.int64)
    return out


@dataclass
class Parameters:
    """Words' and states' context vectors, the two places' matrices, target vectors and biases."""

    word: np.ndarray
    state: np.ndarray
    first: np.ndarray
    second: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.word, self.state, self.first, self.second, self.target, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def like(self, flat: np.ndarray) -> Parameters:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Parameters(*out)


def initial(words: Vocabulary, seed: int = 7) -> Parameters:
    """Small random vectors, and biases that make the model the unigram model."""
    rng = np.random.default_rng(seed)
    eye = np.eye(WIDTH, dtype=np.float32)
    masses = words.masses()
    return Parameters(
        rng.normal(0, 0.3, (words.size + 1, WIDTH)).astype(np.float32),
        rng.normal(0, 0.3, (STATES, WIDTH)).astype(np.float32),
        eye.copy(),
        eye.copy(),
        rng.normal(0, 0.05, (words.size, WIDTH)).astype(np.float32),
        np.log(masses / masses.sum()).astype(np.float32),
    )


def _before(index: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The value one place before, ``start`` where the text has none."""
    out = np.concatenate([[start], index[:-1]])
    out[np.cumsum(sizes) - sizes] = start
    return out


def _scattered(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows with the same index (16 bits sort fastest)."""
    if index.max() < 1 << 16:
        index = index.astype(np.uint16)
    order = np.argsort(index, kind="stable")
    sorted_ = index[order]
    new = np.ones(len(sorted_), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    start = new.nonzero()[0]
    return sorted_[start], np.add.reduceat(values.take(order, 0), start, axis=0)


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps; ``seen`` are the sums of squares so far."""

    def __init__(self, start: Parameters, noise: np.ndarray, seed: int, seen: Parameters | None = None):
        self.p = start.like(start.flat())
        self.log_noise = np.log(RATIO * noise).astype(np.float32)
        self.cumulative = np.cumsum(noise)
        self.cumulative[-1] = 1.0
        self.seen = [np.full_like(x, 1e-3) for x in self.p.parts()] if seen is None else start.like(seen.flat()).parts()
        self.rng = np.random.default_rng(seed)
        self.drawn: list[np.ndarray] = []

    def _noise(self) -> np.ndarray:
        """The noise of a step; it is drawn for many at once."""
        if not self.drawn:
            at = np.searchsorted(self.cumulative, self.rng.random((DRAWN_AT_ONCE, NOISE)))
            self.drawn = list(at[::-1])
        return self.drawn.pop()

    def _apply(self, k: int, rows, gradient: np.ndarray) -> None:
        part, seen = self.p.parts()[k], self.seen[k]
        every = isinstance(rows, slice)
        own = gradient * gradient
        own += seen if every else seen.take(rows, 0)
        seen[rows] = own
        change = RATE * gradient
        change /= np.sqrt(own, out=own)
        change += part if every else part.take(rows, 0)
        part[rows] = change

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, count: np.ndarray) -> None:
        """A step for distinct (word before, state, target) triples that occur ``count`` times."""
        p, n = self.p, len(target)
        x1, x2 = p.word.take(one, 0), p.state.take(two, 0)
        h = x1 @ p.first + x2 @ p.second
        noise = self._noise()
        told = np.concatenate([target, noise])
        known, edge = p.target.take(told, 0), p.bias.take(told) - self.log_noise.take(told)
        q, qn = known[:n], known[n:]
        s = np.einsum("ij,ij->i", h, q) + edge[:n]
        # gradients of the log-likelihood of telling data from noise
        gt = count / (1 + np.exp(np.clip(s, -30, 30)))
        gn = h @ qn.T
        gn += edge[n:]
        np.negative(gn, out=gn)
        np.clip(gn, -30, 30, out=gn)
        np.exp(gn, out=gn)
        gn += 1
        gn = np.divide((-RATIO / NOISE * count)[:, None], gn, out=gn)
        dh = gt[:, None] * q
        dh += gn @ qn
        slope = np.empty((n + NOISE, WIDTH + 1), np.float32)
        np.multiply(gt[:, None], h, out=slope[:n, :-1])
        slope[:n, -1] = gt
        slope[n:, :-1], slope[n:, -1] = gn.T @ h, gn.sum(0)
        rows, dq = _scattered(told, slope)
        words, dw = _scattered(one, dh @ p.first.T)
        # few states: sums by a product; those that don't occur have a gradient of 0
        ds = (two == np.arange(len(p.state))[:, None]).astype(np.float32) @ (dh @ p.second.T)
        d1, d2 = x1.T @ dh, x2.T @ dh
        self._apply(4, rows, dq[:, :-1])
        self._apply(5, rows, dq[:, -1])
        self._apply(0, words, dw)
        self._apply(1, slice(None), ds)
        self._apply(2, slice(None), d1)
        self._apply(3, slice(None), d2)


def fit(coded: DataFrame, words: Vocabulary) -> Parameters:
    """Train on all training documents, in shards and rounds, and average."""
    spark = coded.sparkSession
    p, seen = initial(words), None
    if not words.tokens:
        return p
    noise = words.masses()
    noise = noise / noise.sum()
    shards = -(-words.tokens // (TOKENS_A_SHARD * ROUNDS))
    spread = F.xxhash64("doc_id", "crc")
    train = coded.where("not held_out").select(
        F.pmod(spread, F.lit(ROUNDS)).cast("int").alias("turn"), F.pmod(F.shiftright(spread, 8), F.lit(shards)).cast("int").alias("shard"), "doc_id", "crc", "codes"
    )
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((words.index(), words.says, noise, p, seen))

        own = train.where(F.col("turn") == turn).drop("turn")
        parts = written(own.groupBy("shard").applyInArrow(_shard(shared, turn), _FLAT), "parameters")
        trained = _averaged(parts, shards)
        drop_written(parts)
        if len(trained):
            size = len(p.flat())
            p, seen = p.like(trained[:size]), p.like(trained[size:])
    return p


def _shard(shared, turn: int):
    """Trains on the documents of a shard, in the order of their ids."""

    def run(table: pa.Table) -> pa.Table:
        index, says, noise, p, seen = shared.value
        table = table.sort_by([("doc_id", "ascending"), ("crc", "ascending")])
        shard = table["shard"][0].as_py()
        raw = table["codes"].to_pylist()
        codes, sizes = np.frombuffer(b"".join(raw), "<i4"), np.array([len(r) // 4 for r in raw], np.int64)
        trainer = Trainer(p, noise, 1000 * turn + shard, seen)
        size = len(p.bias)
        own = index[codes]
        triples = (_before(own, sizes, size) * STATES + states(codes, sizes, says)) * size + own
        triples, count = np.unique(triples, return_counts=True)
        order = np.concatenate([trainer.rng.permutation(len(triples)) for _ in range(PASSES)])
        pair, target = np.divmod(triples, size)
        one, two = np.divmod(pair, STATES)
        count = count.astype(np.float32)
        for at in range(0, len(order), BATCH):
            i = order[at : at + BATCH]
            trainer.step(one.take(i), two.take(i), target.take(i), count.take(i))
        flat = np.concatenate([trainer.p.flat(), *(x.ravel() for x in trainer.seen)])
        return pa.Table.from_batches([_weighted(shard, k, len(codes), flat[at : at + BLOCK]) for k, at in enumerate(range(0, len(flat), BLOCK))])

    return run


def _weighted(part: int, block: int, tokens: float, flat: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([float(tokens)]), pa.array([flat.astype(np.float32).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "block", "tokens", "flat"])


def _average(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    tokens = np.array(table["tokens"].to_pylist())
    flat = sum(t / tokens.sum() * np.frombuffer(x, np.float32).astype(np.float64) for t, x in zip(tokens, table["flat"].to_pylist(), strict=True))
    return pa.Table.from_batches([_weighted(table["part"][0].as_py(), table["block"][0].as_py(), tokens.sum(), flat)])


def _averaged(parts: DataFrame, count: int) -> np.ndarray:
    """The weighted mean of ``count`` parts' vectors, by a tree."""
    while count:
        grouped = parts.withColumn("group", (F.col("part") / FAN_IN).cast("int"))
        parts = grouped.groupBy("group", "block").applyInArrow(lambda key, t: _average(t.drop_columns("group")), _FLAT)
        parts = parts.withColumn("part", (F.col("part") / FAN_IN).cast("int"))
        count = -(-count // FAN_IN) if count > FAN_IN else 0
    return np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r["flat"], np.float32) for r in parts.orderBy("block").collect())])


def normalisers(p: Parameters, rows: range | None = None) -> np.ndarray:
    """Natural logarithm of the sum over all targets, for each state and word before (of ``rows``).

    A score is what the word adds and what the state adds, so that the sums of all
    states are one product of two matrices of exponentials, each of one of them.
    """
    one, two = p.word @ p.first, (p.state @ p.second) @ p.target.T + p.bias
    rows = range(len(one)) if rows is None else rows
    top = two.max(1, keepdims=True)
    state = np.exp((two - top).astype(np.float64)).T
    out = np.empty((len(two), len(rows)), np.float32)
    for k in range(0, len(rows), WORDS_AT_ONCE):
        own = one[rows[k : k + WORDS_AT_ONCE]]
        s = (own @ p.target.T).astype(np.float64)
        most = s.max(1, keepdims=True)
        np.exp(s - most, out=s)
        sums = s @ state
        out[:, k : k + WORDS_AT_ONCE] = (most + np.log(np.maximum(sums, LEAST_SUM))).T + top
        # where hundreds lie between the largest of both, the sum is found as it is
        for i, j in np.argwhere(sums <= LEAST_SUM):
            x = (own[i] @ p.target.T).astype(np.float64) + two[j]
            out[j, k + i] = x.max() + np.log(np.exp(x - x.max()).sum())
    return out


def _all_normalisers(spark: SparkSession, p: Parameters) -> np.ndarray:
    """``normalisers`` of all words, found by the executors."""
    shared = spark.sparkContext.broadcast(p)
    number = len(p.word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                found = normalisers(shared.value, range(i, min(i + WORDS_A_TASK, number)))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["i", "flat"])

    out = np.empty((STATES, number), np.float32)
    for r in spark.range(0, number, WORDS_A_TASK, -(-number // WORDS_A_TASK)).mapInArrow(run, "i long, flat binary").collect():
        out[:, r["i"] : r["i"] + WORDS_A_TASK] = np.frombuffer(r["flat"], np.float32).reshape(STATES, -1)
    return out


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, p, norm = shared.value
        head, targets, index = len(words.hashes), words.targets, words.index()
        one_of, two_of = p.word @ p.first, p.state @ p.second
        base = np.append(np.log10((words.counts + SMOOTH) / words.total), 0.0)
        # what a word adds to its bucket's probability; the join adds what words beyond the head do
        share = np.append(np.log10(words.counts + SMOOTH), 0.0)
        share[:targets] = 0
        less = np.log10(words.masses())
        less[:targets] = 0
        for batch, codes, sizes in _batches(batches, 4):
            own, two = index[codes], states(codes, sizes, words.says)
            one = _before(own, sizes, len(p.bias))
            score = np.empty(len(codes))
            for at in range(0, len(codes), TOKENS_AT_ONCE):
                i = slice(at, at + TOKENS_AT_ONCE)
                h = one_of.take(one[i], 0)
                h += two_of.take(two[i], 0)
                score[i] = np.einsum("ij,ij->i", h, p.target.take(own[i], 0)) + p.bias[own[i]] - norm[two[i], one[i]]
            codes = np.minimum(codes, head)
            score = score / np.log(10) + share[codes] - less[own]
            first = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, first) for x in ((codes < head).astype(np.int64), base[codes], score)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, sums), *batch.columns[5:]], _SCORED)

    return run


_SCORED = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "tail_h", "tail_n"]


def learned(docs: DataFrame) -> tuple[DataFrame, DataFrame, Vocabulary, Parameters]:
    """Counts of all training tokens, all documents' codes, the words and the model."""
    counts = written(word_counts(docs), "counts")
    words = vocabulary(counts)
    every = written(_coded(docs, words), "codes")
    words.says = _says(classes_of(_summed(every.where("both is not null").select("both"))))
    coded = every.where("both is null").drop("both")
    coded.table_path = every.table_path
    words.classes = _classified(coded, words)
    return counts, coded, words, fit(coded, words)


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum of all partitions' numbers of documents, by a tree."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TELLING * TELLING)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["flat"])

    once = parts.mapInArrow(add, "flat binary")
    total = np.zeros(TELLING * TELLING)
    for r in once.coalesce(FAN_IN).mapInArrow(add, "flat binary").collect():
        total += np.frombuffer(r["flat"], np.float64)
    return total.reshape(TELLING, TELLING)


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Tokens are the words between ASCII white space, A-Z lower-cased, and an end token.
    ``base_score`` is the smoothed unigram log10 probability of the whole text,
    ``score`` the model's. Reads doc_id and text; a null or empty text is its end token;
    a null doc_id is held out; repeated rows are learned from and scored each; an empty
    table gives an empty result. Ids that are not whole numbers go through as their text.
    """
    spark = docs.sparkSession
    of = docs.schema["doc_id"].dataType
    kind, of = ("bigint", "bigint") if isinstance(of, IntegralType) else ("string", of)
    docs = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts, coded, words, p = learned(docs)
    shared = spark.sparkContext.broadcast((words, p, _all_normalisers(spark, p)))
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, tail_h array<long>, tail_n array<long>"
    heads = coded.select("row", "doc_id", "held_out", "n_tokens", "codes", "tail_h", "tail_n").mapInArrow(_scored(shared), schema)
    heads = written(heads, "scores")
    drop_written(coded)
    tail = heads.select("row", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t")).select("row", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    unseen = tail.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.log10((c + SMOOTH) / words.total)).alias("base_more"),
        F.sum(F.col("n") * F.log10(c + SMOOTH)).alias("score_more"),
    )
    whole = heads.drop("tail_h", "tail_n").join(unseen, "row", "left")
    plus = lambda x, y: F.col(x) + F.coalesce(y, F.lit(0))
    return whole.select(
        F.col("doc_id").cast(of).alias("doc_id"),
        "held_out",
        "n_tokens",
        plus("known", "more").cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        plus("base", "base_more").alias("base_score"),
        plus("score", "score_more").alias("score"),
    )
