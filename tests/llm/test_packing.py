import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridwell.llm.packing import pack, plan, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def expand(counts, capacity):
    """Every piece of a plan: (sequence, offset, length)."""
    out = []
    seen = defaultdict(list)
    for length, rank, number, first, each, offset in plan(counts, capacity):
        for r in range(number):
            out.append((first + r // each, offset + r % each * length, length))
            seen[length].append(rank + r)
    assert {n: sorted(r) for n, r in seen.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    return out


def best_fit(counts, capacity):
    bins = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= n]
        b = min(fit, key=lambda b: bins[b], default=None)
        if b is None:
            bins.append(capacity - n)
        else:
            bins[b] -= n
    return len(bins)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 12), max_size=14))
def test_plan_packs_all_without_gaps(counts):
    placed = expand(counts, 40)
    bins = defaultdict(list)
    for s, o, n in placed:
        bins[s].append((o, n))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 40
    # large pieces are paired to the fewest sequences, which leaves best fit other gaps
    large = sum(c for n, c in counts.items() if 3 * n > 40)
    assert len(bins) <= best_fit(counts, 40) + (1 if large else 0)
    assert len(bins) >= -(-sum(n * c for n, c in counts.items()) // 40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(14, 40), max_size=7))
def test_large_pieces_take_fewest_sequences(lengths):
    def fewest(left):
        if not left:
            return 0
        n, *rest = left
        return 1 + min([fewest(rest)] + [fewest(rest[:i] + rest[i + 1 :]) for i, m in enumerate(rest) if n + m <= 40])

    counts = {n: lengths.count(n) for n in set(lengths)}
    assert len({s for s, _, _ in expand(counts, 40)}) == fewest(sorted(lengths))


def expected(docs):
    tok = Tokenizer.from_file(PATH)
    for doc_id, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            yield (-1 if doc_id is None else doc_id, k, at, len(part), zlib.crc32(part.tobytes()))


def check(got, docs):
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected(docs))
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    return len(bins)


def test_whole_table(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = pack(docs, PATH).collect()
    n = check(got, texts.items())
    counts = defaultdict(int)
    for r in got:
        counts[r["length"]] += 1
    assert n <= best_fit(counts, 2048)


def test_odd_rows(spark, odd, none):
    check(pack(odd, PATH).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert pack(none, PATH).collect() == []


def test_sequences_hold_the_ids(spark, texts):
    some = list(texts.items())[:40]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    tok = Tokenizer.from_file(PATH)
    want = sorted(i for _, t in some for i in [*tok.encode(t, add_special_tokens=False).ids, 0])
    got = sequences(docs, PATH).collect()
    assert sorted(i for r in got for i in r["ids"]) == want
    assert all(len(r["ids"]) == sum(r["lengths"]) <= 2048 for r in got)
