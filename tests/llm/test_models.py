import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridwell.llm import lm, quality
from gridwell.llm.text import space_words


def scored(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return df, lm.score_documents(df).collect()


@pytest.fixture(scope="module")
def small(spark, texts):
    return scored(spark, list(texts.items()))


def check_base(docs, got):
    learnt = Counter()
    for i, t in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            learnt.update([*space_words(t), b""])
    n, v = sum(learnt.values()), len(learnt)
    key = lambda i: -1 if i is None else i
    want = sorted(
        (key(i), len(w := [*space_words(t), b""]), sum(learnt[x] > 0 for x in w), n, sum(math.log10((learnt[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, t in docs
    )
    rows = sorted((key(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    assert [r[:4] for r in rows] == [w[:4] for w in want]
    np.testing.assert_allclose([r[4] for r in rows], [w[4] for w in want], rtol=1e-9)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in got)


def test_base_scores(small, texts):
    check_base(list(texts.items()), small[1])


def test_tail_words_are_joined(spark, texts, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 50)
    some = list(texts.items())[:40]
    check_base(some, scored(spark, some)[1])


def test_odd_rows(spark, odd, none):
    check_base([(r["doc_id"], r["text"]) for r in odd.collect()], lm.score_documents(odd).collect())
    assert lm.score_documents(none).collect() == []


@pytest.mark.parametrize("kind", ["string", "int", "decimal(12,2)"])
def test_ids_are_dealt_by_their_own_text(spark, texts, kind):
    """'007' is not 7: an id's CRC-32 is that of its text as it stands."""
    name = "concat('00', doc_id)" if kind == "string" else "doc_id"
    some = spark.createDataFrame(list(texts.items())[:40], "doc_id long, text string").selectExpr(f"CAST({name} AS {kind}) AS doc_id", "text")
    got = lm.score_documents(some).collect()
    assert any(r["held_out"] for r in got) and not all(r["held_out"] for r in got)
    check_base([(r["doc_id"], r["text"]) for r in some.collect()], got)


def test_model_beats_its_base_on_held_out_texts(small):
    out = [r for r in small[1] if r["held_out"]]
    n = sum(r["n_tokens"] for r in out)
    assert sum(r["score"] for r in out) / n > sum(r["base_score"] for r in out) / n + 0.1


def test_scores_do_not_depend_on_partitions(spark, small, texts):
    df, got = small
    again = {r["doc_id"]: r["score"] for r in lm.score_documents(df.repartition(7)).collect()}
    assert len(again) == len(got)
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], rel=1e-6) for r in got)


@pytest.fixture(scope="module")
def model(spark, small):
    return lm.learned(small[0])


def test_probabilities_are_normalised(model, texts):
    counts, _, words, p = model
    norm = lm.normalisers(p)
    one, two = p.word @ p.first, p.state @ p.second
    for i, j in ((0, 0), (3, 10), (words.size, 0), (words.size - 1, lm.STATES - 1)):
        s = (one[i] + two[j]) @ p.target.T + p.bias
        assert np.exp(s - norm[j, i]).sum() == pytest.approx(1, abs=1e-4)
    # every word is in one target or bucket, whose weights are those of its words and an unseen one
    code = lambda w: int(words.codes(lm._hashes([w]))[0])
    learnt = Counter(w for i, t in texts.items() if not lm.held_out(i) for w in [*space_words(t), b""])
    weight = np.zeros(words.size)
    weight[words.targets :] = lm.SMOOTH
    index = words.index()
    for w, c in learnt.items():
        weight[index[code(w)]] += c + lm.SMOOTH
    np.testing.assert_allclose(weight, words.masses())
    assert words.distinct == len(learnt) > words.targets and counts.count() == len(learnt)


def test_tail_beyond_the_head_is_in_the_masses(spark, small, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 3000)
    words = lm.vocabulary(lm.word_counts(small[0]))
    assert 0 < len(words.hashes) <= 3000 and words.counts.min() > 0
    words.classes = np.zeros(len(words.hashes), np.int64)
    rest = words.distinct - len(words.hashes)
    assert words.tail[1].sum() == rest > 0 and words.tail[0].sum() == words.tokens - words.counts.sum()
    buckets = words.size - words.targets
    assert words.masses().sum() == pytest.approx(words.tokens + lm.SMOOTH * (words.distinct + buckets))


def test_gradient_agrees_with_differences(model):
    words, p = model[2], model[3]
    noise = words.masses() / words.masses().sum()
    t = lm.Trainer(p, noise, 1)
    one, two, target = np.array([1, 2, 3, 1]), np.array([4, 4, 5, 1]), np.array([0, 7, 7, 2])
    seen = {}
    t._apply = lambda k, rows, g: seen.update({k: (rows, g)})
    count = np.array([1, 5, 2, 1], np.float32)
    t.step(one, two, target, count)
    noise_ids = np.searchsorted(t.cumulative, np.random.default_rng(1).random(lm.NOISE))

    def value():
        p = t.p
        h = p.word[one].astype(float) @ p.first + p.state[two].astype(float) @ p.second
        s = (h * p.target[target]).sum(1) + p.bias[target] - t.log_noise[target]
        sn = h @ p.target[noise_ids].T + (p.bias - t.log_noise)[noise_ids]
        return (count * (-np.log1p(np.exp(-s)) - lm.RATIO / lm.NOISE * np.log1p(np.exp(sn)).sum(1))).sum()

    for k, at in ((0, (1, 3)), (1, (4, 2)), (2, (2, 5)), (3, (0, 0)), (4, (7, 4)), (5, (7,))):
        part = t.p.parts()[k]
        kept, step = part[at], 1e-2
        part[at] = kept + step
        up = value()
        part[at] = kept - step
        down = value()
        part[at] = kept
        rows, g = seen[k]
        mine = g[at] if isinstance(rows, slice) else g[(int(np.flatnonzero(rows == at[0])[0]), *at[1:])]
        assert mine == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3)


def test_states_against_a_loop(monkeypatch):
    monkeypatch.setattr(lm, "TOKENS_AT_ONCE", 50)
    rng = np.random.default_rng(3)
    sizes = np.array([1, 300, 2, 64, 65, 1, 120])
    codes = rng.integers(0, 3 * lm.TELLING, sizes.sum())
    says = lm._says(rng.normal(0, 3, (lm.TELLING, lm.CLASSES)))
    got, at = lm.states(codes, sizes, says), 0
    for n in sizes:
        for k in range(n):
            near = [c for c in codes[at + max(0, k - lm.NEAR) : at + k] if c < lm.TELLING]
            total = says[near].sum(0)
            assert got[at + k] == (1 + 2 * int(total[:-1].argmax()) + (len(near) >= lm.MANY) if near else 0)
        at += n


def test_classes_tell_groups_of_words_apart():
    both = np.zeros((lm.TELLING, lm.TELLING))
    for k in range(4):
        both[k * 10 : k * 10 + 10, k * 10 : k * 10 + 10] = 30 + 5 * k
        np.fill_diagonal(both[k * 10 : k * 10 + 10, k * 10 : k * 10 + 10], 60)
    both[40, :41] = both[:41, 40] = 50
    both[40, 40] = 200
    says = lm.classes_of(both)
    kinds = [says[k * 10 : k * 10 + 10].sum(0).argmax() for k in range(4)]
    assert len(set(kinds)) == 4
    assert not lm.classes_of(np.zeros_like(both)).any()


def test_ordinal_classifier_on_held_out_ratings(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    grade = {r["doc_id"]: r["grade"] for r in quality.grades(labels).collect()}
    model = quality.fit(docs, labels.where("doc_id % 4 != 0"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [i for i in grade if i % 4 == 0]
    right = np.mean([got[i]["kept"] == (grade[i] == 2) for i in held])
    assert right > 0.9
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.values())
    assert quality.select(docs, model).count() == sum(r["kept"] for r in got.values())


def test_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (4, 0, 0), (4, 1, 1), (7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r["doc_id"], r["grade"]) for r in quality.grades(labels).collect()} == {(1, 2), (4, 0), (7, 2)}
    model = quality.fit(odd, labels)
    assert quality.score(odd, model).count() == odd.count()
    assert quality.score(none, model).collect() == []
    empty = quality.fit(none, labels)
    assert quality.score(odd, empty).where("kept").count() == odd.count()
    assert quality.select(odd, empty).columns == odd.columns


def test_rare_words_are_learned_from_their_contexts(spark, monkeypatch):
    """Words without targets follow words without targets: order within pairs tells texts apart."""
    monkeypatch.setattr(lm, "WORDS_A_BUCKET", 1)
    filler = " ".join(f"f{k}" for k in range(lm.TARGETS + 10))
    ids = [i for i in range(400) if not lm.held_out(i)]
    held = [i for i in range(400, 500) if lm.held_out(i)][:2]
    pairs = lambda shift, at=0: " ".join(f"c{(at + k) % 20} t{(at + k + shift) % 20}" for k in range(20))
    some = [*((i, filler) for i in ids[:200]), *((i, pairs(0, i)) for i in ids[200:]), (held[0], pairs(0)), (held[1], pairs(7))]
    got = {r["doc_id"]: r for r in scored(spark, some)[1]}
    assert got[held[0]]["base_score"] == pytest.approx(got[held[1]]["base_score"])
    assert got[held[0]]["score"] > got[held[1]]["score"] + 1


def test_buckets_grow_with_the_words(spark):
    def size(n):
        counts = spark.range(n).selectExpr("xxhash64(id) as h", "cast(1 + id % 50 as long) as c")
        return lm.vocabulary(counts).buckets

    assert size(1000) == 1 and size(100_000) == 16 and size(400_000) == 64


def test_distinct_words_are_the_words(odd):
    from gridwell.llm.text import distinct_space_words

    texts = [r["text"] for r in odd.collect()] + [" a\tB\x0bc\x1cd\x85e\xa0F\u2003g \n", "ÀÉ İx", "\x00 A\x00"]
    words, codes, sizes = distinct_space_words(pa.array(texts, pa.string()))
    at = np.cumsum(sizes)
    assert [[words[c] for c in codes[b - n : b]] for n, b in zip(sizes, at, strict=True)] == [space_words(t) for t in texts]


def test_classifier_against_another_optimiser():
    """The fit against plain descent on numerical slopes of the penalised likelihood."""
    rng = np.random.default_rng(2)
    dense = np.concatenate([np.ones((90, 1)), rng.normal(0, 1, (90, 4))], 1).astype(np.float32)
    latent = dense @ np.array([0.2, 2.0, -1.5, 0.7, 0.0]) + rng.logistic(0, 1, 90)
    grade = (latent > -1).astype(int) + (latent > 1)
    model = quality.train([np.arange(5, dtype=np.uint32)] * 90, list(dense), grade.tolist(), dimensions=5, rounds=3000)

    def loss(theta):
        cuts = np.array([theta[5], theta[5] + np.exp(theta[6])])
        p = 1 / (1 + np.exp(-(dense @ theta[:5])[:, None] + cuts))
        reached = grade[:, None] > np.arange(2)
        return -np.mean(np.log(np.where(reached, p, 1 - p)).sum(1)) + quality.DECAY / 2 * (theta[:5] ** 2).sum()

    theta, rate = np.zeros(7), 1.0
    for _ in range(1500):
        slope = np.array([(loss(theta + 1e-5 * e) - loss(theta - 1e-5 * e)) / 2e-5 for e in np.eye(7)])
        while loss(theta - rate * slope) > loss(theta) and rate > 1e-6:
            rate /= 2
        theta, rate = theta - rate * slope, rate * 1.5
    mine = np.concatenate([model.weights, [model.thresholds[0], np.log(np.diff(model.thresholds)[0])]])
    assert loss(mine) == pytest.approx(loss(theta), abs=2e-3)
    cuts = np.array([theta[5], theta[5] + np.exp(theta[6])])
    want = 1 / (1 + np.exp(-(dense @ theta[:5])[:, None] + cuts))
    got = np.array([model.tails(np.arange(5), x) for x in dense])
    np.testing.assert_allclose(got, want, atol=0.03)


def test_classifier_on_repeated_rows_and_ties(spark):
    docs = spark.createDataFrame([(1, "good fine words"), (1, "good fine words"), (2, "bad bad bad"), (3, "good fine words")], "doc_id long, text string").withColumn("kept", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 4 and len({r["tail_probability"] for r in got if r["doc_id"] != 2}) == 1
    model = quality.Model(np.zeros(quality.DIMENSIONS, np.float32), np.array([-1.0, 0.0]))
    # a tail probability that equals the limit is kept
    assert quality.select(docs, model).count() == 4 and quality.select(docs, model).columns == docs.columns


def test_normalisers_of_some_words_are_for_all_states():
    """Parts are rows of words, so that exponentials of words are worked out once for all states."""
    rng = np.random.default_rng(3)
    some = lambda *n: rng.normal(0, 2, n).astype(np.float32)
    size = 3 * lm.WORDS_AT_ONCE + 5
    p = lm.Parameters(some(size + 1, lm.WIDTH), some(lm.STATES, lm.WIDTH), some(lm.WIDTH, lm.WIDTH), some(lm.WIDTH, lm.WIDTH), some(size, lm.WIDTH), some(size))
    # scores of hundreds: the largest of words and of states lie at other targets
    s = ((p.word @ p.first)[None].astype(float) + (p.state @ p.second)[:, None]) @ p.target.T + p.bias
    most = s.max(2, keepdims=True)
    want = (most + np.log(np.exp(s - most).sum(2, keepdims=True)))[:, :, 0]
    assert lm.normalisers(p) == pytest.approx(want, rel=1e-5, abs=1e-3)
    assert lm.normalisers(p, range(130, 390)) == pytest.approx(want[:, 130:390], rel=1e-5, abs=1e-3)
