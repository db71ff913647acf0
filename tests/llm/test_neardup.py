import random

from gridwell.llm.neardup import near_duplicates


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    parent = {i: i for i, _ in docs if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t)) for i, t in docs]
    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((-1 if i is None else i, len(s), -1 if i is None else find(i)) for i, s in sets)


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = near_duplicates(df).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == brute(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_families_larger_than_a_list(spark):
    """Near copies beyond the hot limit, chains, shared passages and short texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    docs = []
    for family in range(2):
        seed = [word() for _ in range(150)]
        for _ in range(70):
            text = list(seed)
            for _ in range(rng.randrange(9)):
                text[rng.randrange(len(text))] = word()
            docs.append(" ".join(text))
    chain = [word() for _ in range(100)]
    for _ in range(20):
        docs.append(" ".join(chain))
        chain = chain[4:] + [word() for _ in range(4)]
    for _ in range(60):
        docs.append(" ".join([*(word() for _ in range(90)), *passage]))
    for _ in range(50):
        docs.append(" ".join(rng.sample(passage, 12)))
    docs += ["a b c", "a  b c", "A B C", "a b", "x " * 300, "x " * 301]
    check(spark, list(enumerate(docs)))


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(spark, rows)
    assert near_duplicates(odd).count() == len(rows)
    assert near_duplicates(none).collect() == []
    check(spark, [(5, "a b c d e f"), (5, "q r s t u v"), (3, "q r s t u v"), (2, "a b c d e f"), (9, "zz")])


def test_nested_pairs_at_the_threshold(spark):
    """Texts of common passages and their extensions at just 0.75: every one meets its base."""
    rng = random.Random(21)
    rows, group = [], {}
    for g in range(25):
        base = [f"g{g}w{i}" for i in range(79)]
        # 75 shingles; 25 more, of the extension's own words
        rows.append((len(rows), " ".join(base)))
        group[rows[-1][0]] = g
        for e in range(40):
            rows.append((len(rows), " ".join([*base, *(f"g{g}e{e}x{rng.randrange(10**6)}" for _ in range(25))])))
            group[rows[-1][0]] = g
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = {}
    for i, g in sorted(group.items()):
        first.setdefault(g, i)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: first[g] for i, g in group.items()}
