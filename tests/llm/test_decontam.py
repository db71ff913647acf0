import hashlib
import random

from gridwell.llm.decontam import contamination, decontaminate
from gridwell.llm.text import alnum_words


def brute(docs, items):
    out = []
    coded = [(i, alnum_words(t)) for i, t in items]
    for _, text in docs:
        words = alnum_words(text)
        hit, found, longest = set(), set(), 0
        for i, item in coded:
            if not item:
                continue
            n = min(10, len(item))
            windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}
            at = [p for p in range(len(words) - n + 1) if tuple(words[p : p + n]) in windows]
            for p in at:
                hit.update(range(p, p + n))
                for q in range(len(item)):
                    k = 0
                    while p + k < len(words) and q + k < len(item) and words[p + k] == item[q + k]:
                        k += 1
                    longest = max(longest, k)
            if at and i is not None:
                found.add(str(i))
        out.append((len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), longest or None))
    return out


def check(spark, docs, items, words=1 << 20):
    import gridwell.llm.decontam as module

    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame(items, "item_id long, text string")
    old, module.search.__defaults__ = module.search.__defaults__, (words,)
    try:
        got = contamination(d, b).collect()
    finally:
        module.search.__defaults__ = old
    want = brute(docs, items)
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got] == [w[:5] for w in want]
    if words > 1000:
        assert [r["longest"] for r in got] == [w[5] for w in want]
    kept = decontaminate(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not w[4] for w in want)


def test_planted_passages(spark):
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 25, 40])))) for i in range(25)]
    items += [(7, items[3][1]), (None, "null id item words here"), (30, None), (31, " . "), (32, "a a a a a a a a a a a a"), (33, items[0][1] + " " + items[1][1])]
    docs = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(80))]
        if i % 3 == 0:
            passage = rng.choice(items[:25])[1].split()
            a = rng.randrange(len(passage))
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
            words += passage[a:]
        docs.append((i, " ".join(words)))
    docs += [(100, "a " * 40), (101, "x. null, id item words HERE!"), (102, items[0][1] + " " + items[1][1])]
    check(spark, docs, items)
    check(spark, docs, items, 60)


def test_odd_rows(spark, odd, none, texts):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(spark, rows, [(1, "one two three"), (2, "word word"), (3, "zz")])
    check(spark, rows, [(1, None)])
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert contamination(none, items).collect() == []
    assert decontaminate(odd, items).columns == odd.columns
    assert contamination(odd, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def test_long_texts_full_of_hits():
    """Longest matches in texts that quote items over and over, against every start; and in seconds."""
    import time

    import numpy as np

    from gridwell.llm.decontam import Tests, _longest, _run_ends, _Shard

    rng = random.Random(4)
    items = [(str(i), [b"w%d" % rng.randrange(4) for _ in range(rng.randrange(10, 60))]) for i in range(12)]
    tests = Tests(items)
    for _ in range(30):
        words = [w for _ in range(8) for w in items[rng.randrange(12)][1][rng.randrange(5) : rng.randrange(5, 60)]]
        shard = _Shard(tests, [b" ".join(words).decode()])
        starts = np.unique(shard.place)
        hit = np.zeros(len(words), bool)
        for s in starts:
            hit[s : s + 10] = True
        want = max((tests.longest(shard.words[s : len(words)])[0] for s in starts), default=0)
        length, start, owner = _longest(tests, shard.words[: len(words)], starts, _run_ends(hit), 0)
        assert length == want
        if want:
            assert start == min(s for s in starts if tests.longest(shard.words[s : len(words)])[0] == want)
            assert b" " + b" ".join(words[start : start + length]) + b" " in b" " + b" ".join(items[owner][1]) + b" "
    tests = Tests([("a", [b"i%d" % k for k in range(500)])])
    text = " ".join(f"i{k % 500}" for k in range(1_500_000))
    began = time.process_time()
    shard = _Shard(tests, [text])
    words = shard.words[: len(shard.words) - 1]
    assert _longest(tests, words, np.unique(shard.place), np.full(len(words), len(words)), 0)[0] == 500
    assert len(text) > 7_000_000 and time.process_time() - began < 30


def test_stages_write_hits_not_texts(spark, tmp_path, monkeypatch):
    """Twelve stages: as one stage gives, columns of any names kept, texts written once."""
    import gridwell.llm.decontam as module

    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    items = [(i if i % 7 else None, " ".join(rng.choices(words, k=rng.randrange(5, 30)))) for i in range(48)]
    docs = [(i % 50, " ".join(rng.choices(words, k=20) + [rng.choice(items)[1]] * (i % 3) + rng.choices(words, k=5)), "x", i) for i in range(60)]
    docs += [(None, None, "y", 1), (7, "", "y", 2), (8, "w1 " * 3000, "z", 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string, row string, stage long").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    names = []
    monkeypatch.setattr(module, "written", lambda df, name, real=module.written: (names.append((name, df.columns)), real(df, name))[1])
    monkeypatch.setattr(module, "BLOCKS_IN_A_STAGE", 1)
    flat = lambda found: sorted((tuple(r) for r in found.selectExpr("doc_id", "text", "row", "stage", "match.n_words", "hex(match.hits)", "match.items", "match.longest").collect()), key=repr)
    got = flat(module.search(d, b, 60))
    assert len([n for n, _ in names if n == "matches"]) > 10 and len([n for n, _ in names if n == "rows"]) == 1
    assert all("c1" not in c for n, c in names if n == "matches")
    assert got == flat(module.search(d, b))
    assert any(r[5] for r in got) and len(got) == 63
