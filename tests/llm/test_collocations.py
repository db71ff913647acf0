import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridwell.llm import collocations


def brute(docs, longest, least, most):
    """Every phrase of every piece, by dictionaries."""
    count, total = Counter(), Counter()
    for text, lang in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang or "und", tuple(words[i : i + k])] += 1
    found = []
    for (lang, phrase), a in count.items():
        if len(phrase) == 1 or a < least:
            continue
        n = total[lang]
        cuts = [(1000 * a * n // (count[lang, phrase[:j]] * count[lang, phrase[j:]]), j) for j in range(1, len(phrase))]
        score, j = min(cuts)
        found.append((lang, phrase, a, count[lang, phrase[:j]], count[lang, phrase[j:]], n, score))
    known = {(x[0], x[1]): x[2] for x in found}
    inside = {(lang, phrase[i:j]) for (lang, phrase), a in known.items() for i in range(len(phrase)) for j in range(i + 2, len(phrase) + 1) if j - i < len(phrase) and known.get((lang, phrase[i:j])) == a}
    out = []
    for lang in {x[0] for x in found}:
        own = sorted((x for x in found if x[0] == lang and (lang, x[1]) not in inside), key=lambda x: (-x[6], -x[2], " ".join(x[1]).encode()))
        out += [(lang, i, " ".join(x[1]), *x[2:]) for i, x in enumerate(own[:most], 1)]
    return sorted(out)


def corpus(seed, words=12, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "New", "york", "中文", "a\x00b"]
    fixed = ["new York city", "one two three four five six", "One two three four", "x x x x x x"]
    docs = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        docs.append(("".join(p + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " ; "]) for p in parts), rng.choice(["en", "en", "de", None])))
    return docs


@pytest.mark.parametrize(("longest", "least", "most"), [(5, 3, 2000), (5, 8, 7), (2, 3, 2000)])
def test_against_all_phrases(spark, longest, least, most):
    docs = corpus(longest * 100 + least) + [(None, "en"), ("", "de"), ("  .\n", "fr")]
    docs += docs[:9]
    df = spark.createDataFrame([(*r, 1, "n") for r in docs], "text string, lang string, n long, word string").repartition(3)
    got = collocations.collocations(df, longest, least, most).collect()
    assert sorted(map(tuple, got)) == brute(docs, longest, least, most)


def test_blocks_of_any_size_hold_the_same_places(monkeypatch):
    """Places within blocks: pieces follow each other with a gap, whatever the batches."""
    import numpy as np
    import pyarrow as pa

    docs = corpus(9, n=40)
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in docs]), pa.array([g for _, g in docs])], ["text", "lang"])

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 2

    monkeypatch.setattr(collocations, "TaskContext", Context)
    want = Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [w.encode().lower().decode() for w in piece.split()] if piece.strip(" \t") else []
            words = [w for w in words if w]
            want.update((lang or "und", a, b) for a, b in zip(words, words[1:], strict=False))
    for size in (1, 500, 1 << 20):
        monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
        rows = [r for b in collocations._blocks(iter([batch.slice(i, 7) for i in range(0, 40, 7)])) for r in b.to_pylist()]
        names = {(r["block"], r["code"]): (r["lang"], r["word"]) for r in rows if r["codes"] is None}
        got = Counter()
        for r in rows:
            if r["codes"] is not None:
                place, code = collocations._places(r["place"]), np.frombuffer(r["codes"], np.int32)
                for i in np.flatnonzero(np.diff(place) == 1):
                    a, b = names[r["block"], code[i]], names[r["block"], code[i + 1]]
                    assert a[0] == b[0]
                    got[a[0], a[1], b[1]] += 1
        assert got == want
        assert all(r["block"] >> 33 == 2 for r in rows) and (size < 1000 or len({r["block"] for r in rows}) == 1)


def test_scores_pass_64_bits(spark):
    values = [(123_456_789_012, 98_765_432_109_876, 123_456_789_013, 223_456_789_012), (3, 10, 7, 11), (10**12, 10**13, 10**12, 10**12)]
    df = spark.createDataFrame(values, "a long, n long, l long, r long")
    got = df.select("a", collocations._score(*(F.col(c) for c in "anlr")).alias("score")).collect()
    assert {r["a"]: r["score"] for r in got} == {a: 1000 * a * n // (left * right) for a, n, left, right in values}


def test_odd_rows(spark, odd, none):
    from gridwell.llm.collocations import collocations as run

    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(map(tuple, run(docs, 5, 3).collect())) == brute([(r["text"], None) for r in docs.collect()], 5, 3, 2000)
    assert run(none.withColumn("lang", F.lit("x"))).collect() == []


def test_plan_has_no_loops_and_no_single_task(spark):
    df = spark.createDataFrame(corpus(3, n=10), "text string, lang string")
    plan = collocations._collocations(df, 4, 2, 50)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan


def test_no_row_for_a_pair_of_a_block(spark, monkeypatch):
    """Pairs travel packed by range: many blocks that share all their words make a row for
    each block and range, and no join of pairs."""
    monkeypatch.setattr(collocations, "LEAST_RANGES", 3)
    rows, made = {}, collocations.written

    def seen(df, name, *more):
        out = made(df, name, *more)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(collocations, "written", seen)
    docs = [(" ".join(f"w{(i * 7 + j * j) % 40}" for j in range(400)), "en") for i in range(40)]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(8)
    assert sorted(map(tuple, collocations.collocations(df, 3, 4, 50).collect())) == brute(docs, 3, 4, 50)
    # answers of 3 ranges to 8 blocks, and the frequent pairs themselves
    assert [n <= 3 * 8 + level for n, level in zip(rows["counted"][-2:], rows["level"], strict=True)] == [True, True] and "pairs" not in rows


def test_numbers_in_little_space_come_back():
    import numpy as np

    for values in ([], [0], [0, 0, 3], [255, 256, 1 << 40], [(1 << 62) + 5, 0]):
        assert collocations._numbers(collocations._squeezed(np.array(values, np.int64))).tolist() == values
    rising = np.array([3, 3, 70_000, 1 << 50])
    assert collocations._rising(collocations._squeezed_rising(rising)).tolist() == rising.tolist()
    assert len(collocations._squeezed_rising(np.arange(100_000))) < 1000


def test_no_row_for_a_word_of_a_block(spark, monkeypatch):
    """Words travel packed by range, too, and blocks are answered in rows of ranges."""
    monkeypatch.setattr(collocations, "LEAST_RANGES", 3)
    rows, made = {}, collocations.written

    def seen(df, name, *more):
        out = made(df, name, *more)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(collocations, "written", seen)
    docs = [(" ".join(f"w{(i + j) % 500} " for j in range(500)), ("en", "de", None)[i % 3]) for i in range(24)]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(8)
    assert sorted(map(tuple, collocations.collocations(df, 2, 6, 50).collect())) == brute(docs, 2, 6, 50)
    # a row for each block; 500 words of three languages, their totals, answers of 3 ranges to 8 blocks
    assert rows["blocks"] <= 8 and rows["words"] <= 3 * 500 + 3 * 3 + 3 * 8
