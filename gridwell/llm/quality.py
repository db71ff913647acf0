"""A quality classifier: ordinal regression with cumulative links on hashed text.

Ratings are graded 0 (toxic), 1 (poor) and 2 (good). One weight vector over hashed
words gives a document a single score; ordered thresholds cut it into grades, so
that P(grade >= j) = sigmoid(score - threshold j). The expected grade is the sum of
those probabilities, and the tail probability that of the highest grade.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwell.llm.text import _ALNUM, distinct_space_words, pieces_by_size

DIMENSIONS = 1 << 18
#: Rated documents that the classifier is fitted to at most: those of the smallest hashes.
SAMPLE_RATED = 8000
GRADES = 3
KEEP_LEAST = 0.5
#: Rated documents that must have a word, or it gets no weight.
RATED_LEAST = 5
ROUNDS = 200
RATE = 0.05
DECAY = 1e-3
#: Norm of a text's words, against that of what describes the whole text.
NORM = 10.0

_DENSE = 6


_FORM = bytes(65 if 0x41 <= c <= 0x5A else 97 if c >= 0x80 or 0x61 <= c <= 0x7A else 48 if 0x30 <= c <= 0x39 else c for c in range(256))
_BARE = bytes(10 if c == 10 else x for c, x in enumerate(_ALNUM))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def _slot(x: bytes) -> int:
    return _DENSE + xxhash.xxh3_64_intdigest(x) % (DIMENSIONS - _DENSE)


def _slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of words without case and punctuation, and of their forms, in which
    letters and digits are alike and a run is one."""
    line = b"\n".join(words)
    bare = np.array([_slot(w.strip()) for w in line.translate(_BARE).split(b"\n")], np.uint32)
    forms = _RUN.sub(rb"\1", line.translate(_FORM)).split(b"\n")
    place = {f: _slot(f if f[:1] == b"\x00" else b"\x00" + f) for f in set(forms)}
    return bare, np.array([place[f] for f in forms], np.uint32)


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text places and values of the whole: which words and forms of words it
    has, in a vector of fixed norm, and how much of it repeats. A text without words has
    the constant alone."""
    words, codes, sizes = distinct_space_words(texts, False)
    bare, form = _slots(words) if words else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    out = []
    for a, n in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
        if not n:
            out.append((np.zeros(1, np.uint32), np.ones(1, np.float32)))
            continue
        own = codes[a : a + n]
        kinds = np.unique(own)
        at = np.unique(np.concatenate([bare[kinds], form[kinds]]))
        value = np.full(len(at), NORM / np.sqrt(len(at)), np.float32)
        # how often a word follows itself, and how many words are distinct
        again = int((own[1:] == own[:-1]).sum()) / n
        dense = [1.0, again, min(1.0, 4 * again), len(kinds) / n, min(1.0, n / 20), min(1.0, n / 200)]
        out.append((np.concatenate([np.arange(_DENSE, dtype=np.uint32), at]), np.concatenate([np.array(dense, np.float32), value])))
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        score = float(self.weights[at] @ value)
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -40, 40)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_by_size(batches, 1):
        found = features(batch.column(1))
        at = pa.array([a.tobytes() for a, _ in found], pa.binary())
        value = pa.array([v.tobytes() for _, v in found], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), at, value], ["doc_id", "grade", "at", "value"])


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of rated documents; ratings with nulls are left out, and of
    several for a doc_id the lowest counts."""
    grade = F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2)
    sound = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return sound.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).cast("int").alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_RATED) -> Model:
    """Fit to at most ``sample`` rated documents; of documents that repeat a doc_id each counts.

    Without rated documents the weights are 0 and every document gets the highest grade.
    """
    chosen = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample is bounded, and so may be broadcast
    rated = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")
    rows = rated.mapInArrow(_rows, "doc_id long, grade int, at binary, value binary").orderBy("doc_id", "at").limit(sample).collect()
    return train([np.frombuffer(r["at"], np.uint32) for r in rows], [np.frombuffer(r["value"], np.float32) for r in rows], [r["grade"] for r in rows])


def train(at: list[np.ndarray], value: list[np.ndarray], grade: list[int], dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> Model:
    """Maximum likelihood by Adam over all rows, with a slight decay of the weights."""
    levels = np.arange(GRADES - 1, dtype=float)
    if not at:
        return Model(np.zeros(dimensions, np.float32), levels - 40)
    found, number = np.unique(np.concatenate(at), return_counts=True)
    common = np.zeros(dimensions, bool)
    common[found] = number >= RATED_LEAST
    common[0] = True  # the constant: no row is empty
    value = [v[common[a]] for a, v in zip(at, value, strict=True)]
    at = [a[common[a]] for a in at]
    used, index = np.unique(np.concatenate(at), return_inverse=True)
    flat = np.concatenate(value).astype(np.float64)
    size = np.array([len(a) for a in at])
    start = np.cumsum(size) - size
    reached = (np.array(grade)[:, None] > levels[None, :]).astype(float)
    rate = np.clip(reached.mean(0), 0.01, 0.99)
    first = -np.log(rate / (1 - rate))
    # first threshold, and logarithms of the distances between thresholds
    cut = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    theta = np.concatenate([np.zeros(len(used)), cut])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, c = theta[: len(used)], theta[len(used) :]
        limits = np.cumsum(np.concatenate([c[:1], np.exp(c[1:])]))
        score = np.add.reduceat(w[index] * flat, start)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - limits, -40, 40)))
        slope = (p - reached) / len(at)
        gw = np.bincount(index, flat * np.repeat(slope.sum(1), size), len(used)) + DECAY * w
        gl = -slope.sum(0)
        later = np.cumsum(gl[::-1])[::-1]
        gc = np.concatenate([later[:1], later[1:] * np.exp(c[1:])])
        g = np.concatenate([gw, gc])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(dimensions, np.float32)
    weights[used] = theta[: len(used)]
    c = theta[len(used) :]
    return Model(weights, np.cumsum(np.concatenate([c[:1], np.exp(c[1:])])))


def score(docs: DataFrame, model: Model, keep_least: float = KEEP_LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, tail_probability, kept.

    ``kept`` says whether the tail probability reaches ``keep_least``. A null or empty
    text is scored by the constant alone; repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_by_size(batches, 1):
            tails = np.array([shared.value.tails(at, value) for at, value in features(batch.column(1))])
            if len(tails):
                columns = [batch.column(0), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep_least)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "tail_probability", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, expected_grade double, tail_probability double, kept boolean"
    )


def select(docs: DataFrame, model: Model, keep_least: float = KEEP_LEAST) -> DataFrame:
    """The rows of ``docs`` whose tail probability reaches ``keep_least``, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def reached(texts: pd.Series) -> pd.Series:
        given = pa.array(texts, pa.large_string(), from_pandas=True)
        return pd.Series([bool(shared.value.tails(at, value)[-1] >= keep_least) for at, value in features(given)], texts.index)

    good = F.pandas_udf(reached, "boolean")
    return docs.where(good(F.col("text").cast("string")))
