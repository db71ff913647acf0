"""Words, shingles and token ids of whole texts.

Arrow cuts a batch of texts into words and finds the distinct ones; what a word needs is
worked out once for each and copied by numpy. A worker keeps nothing from batch to batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

ROWS_PER_PIECE = 64
#: Bytes of text that are encoded at once, if a single text isn't longer.
ENCODED_AT_ONCE = 8 << 20

_ALNUM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between the six ASCII white-space characters."""
    return utf8(text).lower().split()


def distinct_space_words(texts: pa.Array, lower: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of :func:`space_words` of all texts, the number of each word
    among them, and the texts' sizes; as they are written, if not ``lower``."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    words = pc.ascii_split_whitespace(pc.ascii_lower(whole) if lower else whole)
    flat, ends = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    if empty.any():
        flat = flat.filter(pa.array(~empty))
        ends = np.append(0, np.cumsum(~empty))[ends]
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.diff(ends)


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters."""
    return utf8(text).translate(_ALNUM).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A text of fewer words has one shingle, all its words; one without words none.
    """
    words, codes, sizes = distinct_space_words(texts)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[codes]
    factor = np.uint64(0x9E3779B97F4A7C15)
    # at every place of the batch; those that cross texts are left out below
    acc = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for i in range(width):
        acc = mix(acc * factor + h[i : i + len(acc)])
    out = []
    for a, n in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(acc[a : a + n - width + 1]))
        else:
            short = np.full(min(n, 1), n, np.uint64)
            for x in h[a : a + n]:
                short = mix(short * factor + x)
            out.append(short)
    return out


def give_back() -> None:
    """Return what Arrow no longer uses to the system; its pool would keep it."""
    pa.default_memory_pool().release_unused()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: bounds what Python holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        give_back()


def pieces_by_size(batches: Iterator[pa.RecordBatch], column: int, most: int = ENCODED_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of a text column, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end
            give_back()


# Unicode white space.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES_RE2 = re.sub(r"\\u(....)", r"\\x{\1}", _SPACES)
_CHUNK = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
_SPACE = re.compile(f"[{_SPACES}]")
# The split patterns that the two public vocabularies name.
_BYTE_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|[\s]+(?![^\s])|[\s]+"
_WORD_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# The byte-level alphabet, in which bytes of these ranges stand for
# themselves and the others, in ascending order, for the characters from 256 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LEVEL = [(chr(b), chr(256 + i)) for i, b in enumerate(sorted(set(range(256)) - _PLAIN))]

_LATIN_END = 0x250
#: What keeps a chunk from being split here: other scripts, special tokens, a null; and
#: white space of more than one byte for the vocabulary that drops it.
_FOREIGN = r"[^\x01-\x{24f}]|<\|"
#: Capitals whose small letters lie beyond those that the pattern spells out.
_RISING = "".join(f"\\x{{{c:x}}}" for c in range(_LATIN_END) if any(ord(x) >= _LATIN_END for x in chr(c).lower()))
_FOREIGN_WORD = rf"[^\x01-\x{{24f}}]|<\||[\x{{85}}\x{{a0}}{_RISING}]"
_LONGEST = 200
#: Chunks that go to the merges at once.
_AT_ONCE = 40_000
_COPIED_AT_ONCE = 1 << 17


def _latin(pattern: str) -> re.Pattern:
    """A split pattern whose classes are spelled out for the characters up to Latin
    Extended-B; white space as above."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(_LATIN_END) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    return re.compile(pattern.replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"]).replace(r"\s", _SPACES))


class Encoder:
    """Token ids, equal to the tokenizer's own.

    Texts are cut before spaces that follow other characters, where neither vocabulary
    ever joins any. Arrow cuts a batch of texts and finds the distinct chunks, which are
    encoded together and copied to where they occur. Chunks of Latin characters are
    split by the vocabulary's pattern and go to its merges in one call; all others go to
    the tokenizer whole. Nothing is kept from batch to batch.
    """

    def __init__(self, path: str, lower: bool):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        names = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.bytes_of[i] = len(name.removesuffix(suffix))
        self.lower = lower
        self.split = _latin(_WORD_PIECE if lower else _BYTE_PIECE)

    def _direct(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def _merged(self, pieces: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of pieces, and how many each chunk of ``size`` bytes has; none if
        the ids don't end where the chunks do."""
        line = "\x00".join(pieces).encode().decode("latin-1")
        for plain, level in _BYTE_LEVEL[1:]:
            line = line.replace(plain, level)
        ids = np.array(self.merges.encode_batch_fast([line.replace("\x00", " ")], add_special_tokens=False)[0].ids, "<u4")
        have, want = np.append(0, np.cumsum(self.bytes_of[ids])), np.cumsum(size)
        end = np.searchsorted(have, want, "right") - 1
        if (have[end] != want).any() or end[-1:].sum() != len(ids):
            return None
        return ids, np.diff(end, prepend=0)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, each with a space before it, and their numbers."""
        foreign = pc.or_(
            pc.match_substring_regex(words, _FOREIGN_WORD if self.lower else _FOREIGN), pc.greater(pc.binary_length(words), _LONGEST)
        ).to_numpy(zero_copy_only=False)
        parts, counts = [], np.empty(len(words), np.int64)
        places = np.flatnonzero(~foreign)
        for at in range(0, len(places), _AT_ONCE):
            own = places[at : at + _AT_ONCE]
            some = words.take(pa.array(own))
            line = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), pa.scalar(" ", some.type))[0].as_py()
            if self.lower:
                line = line.lower()
                raw = np.frombuffer(line.encode(), np.uint8)
                solid = np.cumsum((raw != 32) & ((raw < 9) | (raw > 13)))
                size = np.diff(solid[np.append(np.flatnonzero(raw == 32)[1:], len(raw)) - 1], prepend=0)
            else:
                size = pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            found = self._merged(self.split.findall(line), size)
            ids, counts[own] = found if found is not None else self._direct([w if self.lower else " " + w for w in some.to_pylist()])
            parts.append(ids)
        rest = np.flatnonzero(foreign)
        if len(rest):
            ids, counts[rest] = self._direct([w if self.lower else " " + w for w in words.take(pa.array(rest)).to_pylist()])
            parts.append(ids)
        # into the words' order
        order = np.concatenate([places, rest])
        flat = np.concatenate([np.zeros(0, "<u4"), *parts])
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return flat, np.stack([first, counts])

    def _as_they_are(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks that may have any white space, or none, at their ends."""
        odd = re.compile("[^\x01-\u024f]|<\\|")
        plain = [len(c) <= _LONGEST and not odd.search(c) for c in chunks]
        own, rest = [c for c, ok in zip(chunks, plain, strict=True) if ok], [c for c, ok in zip(chunks, plain, strict=True) if not ok]
        found = self._merged([p for c in own for p in self.split.findall(c)], np.array([len(c.encode()) for c in own], np.int64))
        (ids, n), (more, m) = found if found is not None else self._direct(own), self._direct(rest)
        order = np.argsort(~np.array(plain, bool), kind="stable")
        count = np.concatenate([n, m])
        where = np.empty((2, len(chunks)), np.int64)
        where[:, order] = np.cumsum(count) - count, count
        return np.concatenate([ids, more]), where

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Each text's ids (unsigned 32-bit); a null text has none."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(texts):
            return []
        words = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        flat, ends = words.flatten(), words.offsets.to_numpy().astype(np.int64)
        first, ends = ends[:-1], ends[1:]
        coded = flat.dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        ids, where = self._words(words)
        if self.lower:
            return _copied(ids, where, codes, ends)
        start = flat.take(pa.array(first)).dictionary_encode()
        edges = pc.match_substring_regex(words, f"^[{_SPACES_RE2}]|[{_SPACES_RE2}]$|^$").to_numpy(zero_copy_only=False)
        odd = self._odd(words, edges, codes, first, ends) if edges.any() else []
        codes = codes.copy()
        codes[first] = len(words) + start.indices.to_numpy(zero_copy_only=False)
        more, there = self._as_they_are(start.dictionary.to_pylist())
        there[0] += len(ids)
        out = _copied(np.append(ids, more), np.concatenate([where, there], 1), codes, ends)
        if len(odd):
            chunks = [_CHUNK.findall(t) for t in texts.take(pa.array(odd)).to_pylist()]
            distinct = pa.array([c for own in chunks for c in own], pa.large_string()).dictionary_encode()
            again = _copied(*self._as_they_are(distinct.dictionary.to_pylist()), distinct.indices.to_numpy(zero_copy_only=False), np.cumsum([len(own) for own in chunks]))
            for i, own in zip(odd.tolist(), again, strict=True):
                out[i] = own
        return out

    def _odd(self, words: pa.Array, edges: np.ndarray, codes: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The texts that have a space next to other white space."""
        names = words.filter(pa.array(edges)).to_pylist()
        begins, stops = edges.copy(), edges.copy()
        begins[edges] = [not w or bool(_SPACE.match(w)) for w in names]
        stops[edges] = [bool(w) and bool(_SPACE.match(w[-1])) for w in names]
        before, after = begins[codes], stops[codes]
        before[first], after[ends - 1] = False, False
        return np.flatnonzero(np.add.reduceat((before | after).astype(np.int64), first))


def _copied(ids: np.ndarray, where: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The ids of texts that are runs of ``codes``; ``where`` has each code's first place and number."""
    last = np.append(0, np.cumsum(where[1, codes]))
    out = np.empty(last[-1], "<u4")
    for at in range(0, len(codes), _COPIED_AT_ONCE):
        first, n = where[:, codes[at : at + _COPIED_AT_ONCE]]
        a, b = last[at], last[at + len(n)]
        out[a:b] = ids[np.repeat(first - last[at : at + len(n)], n) + np.arange(a, b)]
    at = np.append(0, last[ends])
    return [out[a:b] for a, b in zip(at, at[1:], strict=False)]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, lower: bool) -> Encoder:
    """The worker's encoder of a vocabulary file. ``lower``: the one with word ends."""
    if (path, lower) not in _encoders:
        _encoders[path, lower] = Encoder(path, lower)
    return _encoders[path, lower]
