"""URL rules by a cascade of Bloom filters, in DataFrame functions alone.

The corpus's complete key universe is every (host suffix, path prefix) that some
URL has and that could be a rule by its shape. Level 0 encodes the listed keys,
with so few false positives over that universe that about as many remain as there
are listed keys; level 1 encodes those false positives, level 2 the listed keys that
level 1 takes for false, and so on until a level errs on nothing. Membership of any
key of the universe is then exact, and scanning the pages needs no join.

Lists have paths of many lengths. A URL is first asked only for the paths cut to a power
of two, one cascade of which tells those with which a rule begins; under these alone it
is asked for the lengths that rules have up to the next power. So a URL has at most
labels * (log2 of the longest path + 2) keys, and some more only where a rule of the
same host begins as it does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwell.session import written

#: The rules (verdict, host, path) of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """A Bloom filter: its bits in words of 64, and its number of hashes."""

    words: tuple[int, ...]
    hashes: int


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _key(host: Column, path: Column, shape: Column) -> Column:
    """A URL's key of a shape (see :func:`_shape`), null if it has none."""
    labels = F.split(host, r"\.", -1)
    n, size = F.shiftright(shape, 32).cast("int"), shape.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    fits = (host != "") & (F.size(labels) >= n) & (F.length(path) >= size)
    return F.when(fits, F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, F.lit(1), size)))


def keys(host: Column, path: Column, shapes: Column) -> Column:
    """The keys of a URL that have one of ``shapes``: array<string>. Other keys can't be rules."""
    return F.array_compact(F.transform(shapes, lambda shape: _key(host, path, shape)))


def _shape(n: int, size: int) -> int:
    """Host labels and path length as one number."""
    return n << 32 | size


def _anchor(size: int) -> int:
    """The largest power of two that a path of ``size`` has room for."""
    return 1 << size.bit_length() - 1 if size else 0


@dataclass(frozen=True)
class Shapes:
    """The shapes of rules, and those of the rules' beginnings: each of these has
    ``count`` shapes in ``full``, from ``start`` (from 1)."""

    anchors: tuple[int, ...]
    start: tuple[int, ...]
    count: tuple[int, ...]
    full: tuple[int, ...]

    @staticmethod
    def of(found: list[tuple[int, int]]) -> Shapes:
        grouped: dict[tuple[int, int], list[int]] = {}
        for n, size in sorted(found):
            grouped.setdefault((n, _anchor(size)), []).append(_shape(n, size))
        full = tuple(s for group in grouped.values() for s in group)
        count = tuple(len(group) for group in grouped.values())
        start = tuple(1 + sum(count[:i]) for i in range(len(count)))
        return Shapes(tuple(_shape(*a) for a in grouped), start, count, full)

    def under(self, host: Column, path: Column, begins: list[Level]) -> Column:
        """The shapes that rules with a URL's beginnings may have."""
        anchors, start, count, full = (_longs(list(v)) for v in (self.anchors, self.start, self.count, self.full))

        def some(i: Column) -> Column:
            at = (i + 1).cast("int")
            key = _key(host, path, F.element_at(anchors, at))
            own = F.slice(full, F.element_at(start, at).cast("int"), F.element_at(count, at).cast("int"))
            return F.when(key.isNotNull() & member(key, begins), own)

        return F.flatten(F.array_compact(F.transform(_longs(list(range(len(self.anchors)))), some)))


def _longs(values: list[int]) -> Column:
    """A constant array: one string, which the optimizer turns into numbers once."""
    if not values:
        return F.array().cast("array<long>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _bit(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits))


def _in_level(key: Column, number: int, level: Level) -> Column:
    """Whether all of a key's bits are set."""
    bits = 64 * len(level.words)
    words = _longs(list(level.words))
    tests = []
    for i in range(level.hashes):
        at = _bit(key, number, i, bits)
        word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
        tests.append(F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _encode(frame: DataFrame, number: int, count: int, hashes: int) -> Level:
    """A filter of the keys in ``frame``; its size follows from their ``count``."""
    bits = 64 * max(1, math.ceil(1.45 * count * hashes / 64))
    each = frame.select(F.explode(F.array(*(_bit(F.col("key"), number, i, bits) for i in range(hashes)))).alias("at"))
    word = each.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b"))
    words = [0] * (bits // 64)
    for r in word.collect():
        words[r["w"]] = r["b"]
    return Level(tuple(words), hashes)


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Filters by which a key of ``universe`` is listed exactly if :func:`member` says so.

    Both have the column ``key``, of distinct keys; listed keys need not be in the
    universe. The filters' size follows the list and the logarithm of the universe.
    """
    listed = written(listed, "listed")
    n, total = listed.count(), universe.count()
    levels: list[Level] = []
    if not n:
        return levels
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    while True:
        number = len(levels)
        hashes = max(1, math.ceil(math.log2(math.sqrt(2) * max(1, total) / n))) if not number else 1
        levels.append(_encode(inside, number, inside.count(), hashes))
        wrong = written(outside.where(_in_level(F.col("key"), number, levels[-1])), "wrong")
        if wrong.isEmpty():
            return levels
        inside, outside = wrong, inside


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(False)
    for number in reversed(range(len(levels))):
        inner = ~out if number + 1 < len(levels) else F.lit(True)
        out = _in_level(key, number, levels[number]) & inner
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` has verdict (allow or block), host and path. A rule fits its host and
    all subdomains where the URL's path starts with the rule's; the longest rule
    wins, of equally long ones that of the longer host; if one is listed with both
    verdicts, block counts. Without a fitting rule, ``rule`` is null and the verdict
    is ``default``. A null URL or one without ``://`` has an empty host and path, which
    no rule fits. Rules with a null or empty host, or a null path, are left out.
    So are those that fit no URL: hosts with ``/``, ``?`` or ``#``, paths that begin with
    something other than ``/``. Repeated pages are judged alike; an empty table gives an
    empty result.
    """
    rules = rules.where("host rlike '^[^/?#]+$' and (path = '' or path like '/%')").select(
        "verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path"
    )
    size = F.length("path")
    # at most as many rows as hosts have labels times the lengths of paths
    found = rules.select(F.size(F.split("host", r"\.", -1)).alias("n"), size.alias("size")).distinct().collect()
    shapes = Shapes.of([(r["n"], r["size"]) for r in found])
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    host, path = F.col("host"), F.col("path")
    asked = parsed.select(F.explode(keys(host, path, _longs(list(shapes.anchors)))).alias("key")).distinct()
    power = F.when(size > 0, F.pow(F.lit(2), F.length(F.bin(size)) - 1)).otherwise(0).cast("int")
    begins = cascade(rules.select(F.concat("host", F.substring("path", F.lit(1), power)).alias("key")).distinct(), written(asked, "beginnings"))
    own = shapes.under(host, path, begins)
    known = written(parsed.select(F.explode(keys(host, path, own)).alias("key")).distinct(), "universe")
    key = F.concat("host", "path").alias("key")
    block = rules.where("verdict = 'block'").select(key).distinct()
    allow = rules.where("verdict != 'block'").select(key).distinct().join(block, "key", "left_anti")
    blocked, allowed = cascade(block, known), cascade(allow, known)

    def ruled(k: Column, verdict: str) -> Column:
        slash = F.instr(k, "/")
        host_size = F.when(slash > 0, slash - 1).otherwise(F.length(k))
        return F.struct(F.length(k).alias("size"), host_size.alias("h"), k.alias("rule"), F.lit(verdict).alias("verdict"))

    judged = F.transform(
        keys(host, path, own),
        lambda k: F.when(member(k, blocked), ruled(k, "block")).when(member(k, allowed), ruled(k, "allow")),
    )
    best = F.array_max(F.array_compact(judged))
    return parsed.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
