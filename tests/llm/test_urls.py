import random

from pyspark.sql import functions as F

from gridwell.llm.urls import RULES, Shapes, cascade, filter_urls, member

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate(str.maketrans(UP, LOW)), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


URLS = [
    None, "", "no scheme", "http://", "https://NET/", "http://a.net", "http://a.net/", "http://a.net?x=/en/", "http://Sub.Example.NET/en/1?q#f",
    "http://example.net/EN/", "https://example.com/de/", "ftp://x.example.com/de/a#b", "http://notexample.com/de/", "http://a.org/fr/1://b", "http://..net/x",
    "http://a.b.c.d.e.org/fr/", "http://é.net/ü", "x://net/\n/y", "http://example.com./de/", "://net/a",
]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(2)
    got = filter_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [brute(u, rules) for u in urls]


def test_fixed_rules(spark):
    check(spark, [*URLS, *URLS], RULES)


def test_other_rules(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice(["a", "b", "c", "org", "net"]) for _ in range(rng.randrange(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/x", "y", "/en/"]) for _ in range(rng.randrange(3)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(60))}.values())
    check(spark, [f"http://{host()}/{path()}" for _ in range(400)], [*rules, ("block", None, "/"), ("allow", "a", None)])
    check(spark, ["http://a/"], [("allow", None, None)])


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 5000, 37).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = cascade(listed, universe)
    assert len(levels) > 1
    got = universe.where(member(F.col("key"), levels)).collect()
    assert {r["key"] for r in got} == {r["key"] for r in listed.collect()}


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(none, spark.createDataFrame(RULES, "verdict string, host string, path string")).collect() == []


def test_main_path_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = filter_urls(pages, spark.createDataFrame(RULES, "verdict string, host string, path string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


def test_long_lists_stay_cheap(spark):
    """A list of 20,000 rules of many shapes: filters are constants of a small plan."""
    import time

    from pyspark.sql import functions as F

    listed = spark.range(20_000).selectExpr("concat('h', id, '.example.com/', repeat('p', cast(id % 40 as int)), '/') as key")
    universe = listed.unionByName(spark.range(60_000).selectExpr("concat('x', id, '.org/') as key")).distinct()
    began = time.time()
    levels = cascade(listed, universe)
    wrong = universe.withColumn("found", member(F.col("key"), levels)).join(listed.withColumn("real", F.lit(True)), "key", "left")
    assert wrong.where("found != coalesce(real, false)").count() == 0
    assert time.time() - began < 60
    rules = listed.selectExpr("'block' as verdict", "substring_index(key, '/', 1) as host", "substring(key, instr(key, '/')) as path")
    pages = spark.createDataFrame([(1, "http://a.h7.example.com/ppppppp/x"), (2, "http://h7.example.com/pppppp/x"), (3, "http://h40.example.com//")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(pages, rules).collect()}
    assert got == {1: ("h7.example.com/ppppppp/", "block"), 2: (None, "allow"), 3: ("h40.example.com//", "block")}


def test_hundreds_of_path_lengths(spark):
    """Rules of 300 lengths under two hosts: the same verdicts, and few keys a page."""
    rng = random.Random(7)
    path = lambda n: "/" + "".join(rng.choice("ab/") for _ in range(n - 1))
    long = path(400)
    rules = [("block" if n % 3 else "allow", "site.org", long[:n]) for n in range(1, 300, 2)]
    rules += [(rng.choice(["allow", "block"]), "b.net", path(n)) for n in range(1, 300)] + [("block", "ay", ""), ("block", "a", "y")]
    urls = [f"http://x.site.org{long[:n]}" for n in range(0, 330, 7)] + [f"http://site.org{long[:n]}c{long}" for n in range(1, 60, 5)]
    urls += [f"http://{rng.choice(['b.net', 'c.b.net', 'net'])}{rng.choice(rules)[2][: rng.randrange(1, 300)]}{path(3)}?{long}" for _ in range(150)]
    check(spark, [*urls, "http://ay/", "http://a/y", "http://a", None], rules)


def test_pages_without_listed_beginnings_have_few_keys(spark):
    shapes = Shapes.of([(2, n) for n in range(1, 1000)])
    assert len(shapes.anchors) == 10 and len(shapes.full) == 999 and sum(shapes.count) == 999
    page = spark.createDataFrame([("a.net", "/" + "q" * 1200)], "host string, path string")
    none = cascade(spark.createDataFrame([("a.net/z",)], "key string"), spark.createDataFrame([("a.net/q",)], "key string"))
    own = shapes.under(F.col("host"), F.col("path"), none)
    assert page.select(F.size(own).alias("n")).first()["n"] < 999


def test_rules_that_fit_no_url_are_left_out(spark):
    rules = [("block", "a", "y"), ("block", "a/b", ""), ("block", "a?", "/"), ("block", "", "/"), ("allow", "b", "")]
    check(spark, ["http://ay", "http://a/b", "http://a?/", "http://b", "http://c.b/x"], rules)
