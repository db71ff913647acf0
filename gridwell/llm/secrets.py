"""Secret scans that link the parts of credentials.

Some secrets can be told by themselves: an assignment to a telling name, an access
identifier of a known form, a long run of hexadecimal digits. Others are mere
candidates: a random-looking word, a user name, a host. Those are linked: each text
is cut into scopes of neighbouring lines, the parts of a text are ordered by place,
and an interval join within scopes (a sweep that keeps only parts still in reach)
pairs random-looking words with access identifiers and endpoints. A candidate is
reported only if a complementary part lies within reach; hosts and names alone never.
A word inside an endpoint or identifier leaves it one for other words. With its own
it makes a credential only in a URL: in the part before the host, or where a segment
after the host is random-looking by itself; the host is then left out of the secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwell.llm.text import pieces

# The patterns of the strong kinds, and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ["assign", "access", "hex", "secret", "identifier", "endpoint"]

#: Code points between linked parts at most, by default; a blank line ends a scope.
REACH = 200
WORD_LEAST = 20
ENTROPY_LEAST = 3.5

_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")
_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_IDENTIFIER = re.compile(r"""\b(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.IGNORECASE | re.ASCII)
_HOST = re.compile(r"""\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,}""", re.IGNORECASE | re.ASCII)
_ADDRESS = re.compile(r"""://[^\s"'<>]+""", re.ASCII)
_SCHEME = re.compile(r"\b[a-z]", re.IGNORECASE | re.ASCII)
_SCHEME_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_URL = re.compile(r"[a-z][a-z0-9+.-]*://(?:([^/?#]*)@)?([^/?#]*)", re.IGNORECASE | re.ASCII)
_SCOPE = re.compile(r"\n[ \t\r]*\n")


@dataclass(frozen=True, order=True)
class Span:
    """A part in code points, end exclusive; kinds are ordered as in ``KINDS``."""

    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def strong(text: str) -> list[Span]:
    """The secrets that can be told by themselves."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMED):
        found += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # a run is found whole, so only long runs need be looked for
    found += [Span(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def _random(word: str) -> bool:
    """Whether a word has upper and lower case, digits and a high entropy."""
    if not (re.search("[A-Z]", word) and re.search("[a-z]", word) and re.search("[0-9]", word)):
        return False
    n = len(word)
    return -sum((c := word.count(x) / n) * math.log2(c) for x in set(word)) >= ENTROPY_LEAST


def _overlap(x: Span, y: Span) -> bool:
    return x.start < y.end and y.start < x.end


def _url_start(text: str, at: int, least: int) -> int | None:
    """Where the scheme before a ``://`` at ``at`` begins: the first letter, at the border of
    a word, of the run of a scheme's characters there; no earlier than ``least``."""
    first = at
    while first > least and text[first - 1] in _SCHEME_LETTERS:
        first -= 1
    found = _SCHEME.search(text, first, at)
    return found.start() if found else None


def endpoints(text: str) -> list[Span]:
    """URLs and named hosts, leftmost first and apart. Each ``://`` is looked back from
    once, so that the time is in proportion to the text."""
    out, end = [], 0
    host, address, url = _HOST.search(text), _ADDRESS.search(text), None
    while host or address:
        if address and url is None:
            url = _url_start(text, address.start(), end)
            if url is None:
                # what follows may have another one
                address = _ADDRESS.search(text, address.start() + 3)
                continue
        if address and (not host or url <= host.start()):
            out.append(Span(url, 5, address.end()))
        else:
            out.append(Span(host.start(), 5, host.end()))
        end = out[-1].end
        if host and host.start() < end:
            host = _HOST.search(text, end)
        if address and url < end:
            # an address may begin before the end of a host and still have a scheme after it
            at = address.start() if address.start() >= end else end
            address, url = _ADDRESS.search(text, at), None
    return out


def _hosts(text: str, endpoints: list[Span]) -> dict[Span, tuple[int, int, int]]:
    """For each URL where its user part, its host and what follows the host start."""
    found = {p: _URL.match(text, p.start, p.end) for p in endpoints}
    return {p: (m.start(2) if m[1] is None else m.start(1), m.start(2), m.end()) for p, m in found.items() if m}


def _secret_parts(word: Span, url: tuple[int, int, int]) -> tuple[Span, Span]:
    """What a word has of a URL's user part and of what follows its host."""
    user, host, after = url
    return Span(max(word.start, user), 3, min(word.end, host)), Span(max(word.start, after), 3, word.end)


def _credential(text: str, word: Span, url: tuple[int, int, int]) -> bool:
    """Whether a word inside a URL is a secret that its host is the endpoint of."""
    before, behind = _secret_parts(word, url)
    if behind == word and "/" not in text[word.start : word.end]:
        return True
    segments = text[behind.start : behind.end].split("/")
    return before.start < before.end or any(len(s) >= WORD_LEAST and _random(s) for s in segments)


def _without_host(text: str, word: Span, url: tuple[int, int, int]) -> Span:
    """A word without what it has of scheme and host, if the rest is still random-looking."""
    for cut in _secret_parts(word, url):
        if cut == word:
            return word
        if cut.end - cut.start >= WORD_LEAST and _random(text[cut.start : cut.end]):
            return cut
    return word


def _apart(words: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``words`` (in order, apart) that no span of ``base`` (by start) overlaps: one sweep."""
    out, k, end = [], 0, 0
    for w in words:
        while k < len(base) and base[k].start < w.end:
            end = max(end, base[k].end)
            k += 1
        if end <= w.start:
            out.append(w)
    return out


def linked(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Candidates with a complementary part in reach, and the identifiers that link to one.

    A sweep by place: words and parts still in reach are kept apart, and each meets
    those of the other kind, of which those out of reach are dropped first. Spans of a
    kind don't overlap, so that few are in reach.
    """
    words = _apart([Span(m.start(), 3, m.end()) for m in _WORD.finditer(text) if _random(m[0])], base)
    if not words:
        return []
    parts = [s for s in base if s.kind == 1]
    parts += [Span(m.start(), 4, m.end()) for m in _IDENTIFIER.finditer(text)]
    ends = endpoints(text)
    parts += ends
    urls = _hosts(text, ends)
    places = sorted(urls)
    for i, w in enumerate(words):
        # endpoints don't overlap, so the last one that starts before the word's end is the only one
        at = bisect_left(places, Span(w.end, 0, 0)) - 1
        if at >= 0 and _overlap(w, places[at]):
            words[i] = _without_host(text, w, urls[places[at]])
    breaks = [m.start() for m in _SCOPE.finditer(text)]
    out: set[Span] = set()
    #: words and parts still in reach of what follows
    near: tuple[list[Span], list[Span]] = [], []
    scope = 0
    for s in sorted([*words, *parts]):
        while scope < len(breaks) and breaks[scope] < s.start:
            near[0].clear()
            near[1].clear()
            scope += 1
        mine, others = near if s.kind == 3 else near[::-1]
        others[:] = [x for x in others if x.end + reach >= s.start]
        for x in others:
            word, part = (x, s) if x.kind == 3 else (s, x)
            if not _overlap(word, part) or (part in urls and _credential(text, word, urls[part])):
                out |= {y for y in (x, s) if y.kind in (3, 4)}
        if not mine or mine[-1] != s:
            mine.append(s)
    return sorted(out)


def spans(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """Strong spans, and all."""
    if not text:
        return [], []
    base = strong(text)
    return base, sorted({*base, *linked(text, base, reach)})


def _joined(found: list[Span]) -> str:
    return ",".join(map(str, found))


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.
    Linked parts of a scope are at most ``reach`` code points apart.

    ``spans`` lists kind:start:end by start, then kind; ``base_sha256`` is the hash of
    that list of the strong kinds. Reads doc_id and text; a null or empty text has no
    spans, repeated rows are scanned alike, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [spans(t, reach) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s.kind == k for s in base) for base, _ in found], pa.int64()) for k in range(3)]
            digest = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digest, pa.string()), pa.array([_joined(x) for _, x in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redacted(text: str, reach: int = REACH) -> str:
    """The text with every secret replaced by its kind; overlapping spans as one."""
    out, at, hidden = [], 0, 0
    for s in spans(text, reach)[1]:
        if s.start >= hidden:
            out += [text[at : s.start], f"<{KINDS[s.kind]}>"]
        hidden = max(hidden, s.end)
        at = hidden
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with secrets replaced in ``text``, other columns and rows unchanged.

    ``n_chars``, if there is such a column, becomes the new length of changed texts.
    Other columns may have any names.
    """

    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, reach) if t else t)

    names = [f"c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    text = F.col(own["text"])
    shown = docs.toDF(*names).withColumn("clean", F.pandas_udf(cleaned, "string")(text.cast("string")))
    new = {"text": F.col("clean")}
    if "n_chars" in own:
        size = F.when(~text.eqNullSafe(F.col("clean")), F.length("clean")).otherwise(F.col(own["n_chars"]))
        new["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return shown.select(*(new.get(c, F.col(n)).alias(c) for c, n in own.items()))
