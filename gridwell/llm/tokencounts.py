"""Token counts of whole texts by finite-state machines.

A byte-level BPE tokenizer is compiled into two deterministic transducers.

The first cuts texts into pieces (words with the space before them, numbers, other
characters, white space, contractions). It reads classes of characters, has ten states,
and its transitions say where a piece begins. Texts are cut into chunks of equal length;
a chunk's map of states, from each state it may be entered in to the one it is left in,
is worked out for all chunks in step, the maps are composed by a parallel prefix scan,
and each chunk is read again from the state that the scan gives it.

The second reads the bytes of a piece, and its transitions say how many tokens more (or
fewer) the bytes so far have. That number is defined because of two facts on BPE: the
last token of a prefix together with the tokens of what comes before it is the
tokenization of the prefix, and tokens stand side by side if no merge would have crossed
the border between them before both were whole. A state holds the places from which a
token may still be under way: its node in the trie of tokens, the token that ends there,
and the count there relative to the present one. There are too many such
states to list them all, so transitions are made when text first takes them, and a
worker carries up to ``MOST_STEPS`` of them from batch to batch. A batch's distinct
pieces are read in step. Pieces longer than a chunk (a run of one letter, a text in a
script without spaces) are cut into chunks too, whose maps have only the states that
they are entered in and are chained; chunks with the same bytes share a map.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwell.llm.text import pieces_by_size

#: Characters of a chunk for the first machine, and bytes of one for the second.
CHUNK, PIECE_CHUNK = 1024, 192
#: Transitions of the second machine that a worker carries from batch to batch at most.
MOST_STEPS = 1 << 19
NEVER = 1 << 62
#: Bytes of text read at once, if a single text isn't longer.
READ_AT_ONCE = 8 << 20

# Classes of characters: the end of a text, space, other white space, numbers, others,
# the apostrophe, letters; letters that are a contraction's only one, that need an e
# after them, e, and l.
END, SPACE, WHITE, NUMBER, OTHER, APOSTROPHE, LETTER, SINGLE, BEFORE_E, E, L = range(11)
CLASSES = 11
_LETTERS = (LETTER, SINGLE, BEFORE_E, E, L)
# States: at the start, in letters, in numbers, in others, after a space, after other
# white space, after an apostrophe that began a piece, after that and a letter that
# needs an e or an l, and after a contraction.
S_START, S_LETTERS, S_NUMBERS, S_OTHERS, S_SPACE, S_WHITE, S_APOSTROPHE, S_NEEDS_E, S_NEEDS_L, S_CONTRACTED = range(10)
STATES = 10
#: What a transition says: a piece begins at this character, or at the one before it.
HERE, BEFORE = 1, 2


def cutter() -> tuple[np.ndarray, np.ndarray]:
    """The next state and the cuts, by state * CLASSES + class."""
    into = {SPACE: S_SPACE, WHITE: S_WHITE, NUMBER: S_NUMBERS, OTHER: S_OTHERS, APOSTROPHE: S_APOSTROPHE, END: S_START} | dict.fromkeys(_LETTERS, S_LETTERS)
    after = {S_LETTERS: _LETTERS, S_NUMBERS: (NUMBER,), S_OTHERS: (OTHER, APOSTROPHE), S_SPACE: (SPACE, WHITE), S_WHITE: (SPACE, WHITE)}
    goes, says = np.zeros(STATES * CLASSES, np.uint8), np.zeros(STATES * CLASSES, np.uint8)
    for state in range(STATES):
        for kind in range(CLASSES):
            target, cuts = into[kind], HERE
            if kind in after.get(state, ()):
                target, cuts = (into[kind] if kind in (SPACE, WHITE) else state), 0
            elif kind != END and state == S_SPACE:
                # the last space belongs to what follows
                target, cuts = (S_OTHERS if kind == APOSTROPHE else target), BEFORE
            elif kind != END and state == S_WHITE:
                cuts = BEFORE | HERE
            elif state == S_APOSTROPHE and kind in (OTHER, APOSTROPHE):
                target, cuts = S_OTHERS, 0
            elif state == S_APOSTROPHE and kind in (SINGLE, BEFORE_E, L):
                target, cuts = {SINGLE: S_CONTRACTED, BEFORE_E: S_NEEDS_E, L: S_NEEDS_L}[kind], 0
            elif (state, kind) in ((S_NEEDS_E, E), (S_NEEDS_L, L)):
                target, cuts = S_CONTRACTED, 0
            elif state in (S_NEEDS_E, S_NEEDS_L):
                # no contraction: the apostrophe was a piece, and the letter began one
                cuts = BEFORE | (0 if kind in _LETTERS else HERE)
            goes[state * CLASSES + kind], says[state * CLASSES + kind] = target, cuts
    return goes, says


def composed(maps: np.ndarray) -> np.ndarray:
    """For each chunk the map of all chunks up to it: a prefix scan by doubling steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        # first what the earlier chunks do, then the later ones
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), 1)
        step *= 2
    return out


def cuts(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pieces begin, of characters' classes that end with ``END``."""
    goes, says = cutter()
    n = len(kinds)
    # a start state meets only ends in the padding
    grid = np.zeros((-(-n // chunk), chunk), np.uint8)
    grid.reshape(-1)[:n] = kinds
    steps = np.ascontiguousarray(grid.T)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (len(grid), 1))
    for kind in steps:
        maps = goes[maps * np.uint8(CLASSES) + kind[:, None]]
    now = np.append(np.uint8(S_START), composed(maps)[:-1, S_START]).astype(np.uint8)
    said = np.empty_like(steps)
    for i, kind in enumerate(steps):
        at = now * np.uint8(CLASSES) + kind
        said[i], now = says[at], goes[at]
    said = np.ascontiguousarray(said.T).reshape(-1)[:n]
    begins = (said & HERE) > 0
    begins[:-1] |= (said[1:] & BEFORE) > 0
    begins[0] = True
    return begins


class Machine:
    """A vocabulary's two transducers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.cutter = tokenizer.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        model = stated["model"]
        plain = stated["pre_tokenizer"]
        if stated["normalizer"] or plain["type"] != "ByteLevel" or not plain["use_regex"] or plain["add_prefix_space"]:
            raise ValueError("a byte-level vocabulary without normalizer is needed")
        self.special = [t["content"] for t in stated["added_tokens"]]
        self.kinds = np.full(0x110000, 255, np.uint8)
        names = model["vocab"]
        #: by pair of tokens: when they are merged
        self.merge = {names[a] << 20 | names[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self.born = {names[a + b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.halves = {names[a + b]: (names[a], names[b]) for a, b in model["merges"]}
        letters = bytes_of_letters()
        self.trie: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for name, token in names.items():
            if len(name) > 1 and token not in self.halves:
                continue
            node = 0
            for c in name:
                b = letters[c]
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = self.trie[node][b]
            self.token_at[node] = token
        self.clear()

    def clear(self) -> None:
        """Forget all states but the start."""
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.pairs: dict[int, bool] = {}
        #: by state << 8 | byte: the next state << 8, and the tokens more, from -128 up
        self.known: dict[int, int] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that were at a token's right (1) or left (0) end: each, when it was
        made, and when it was merged away."""
        out, until = [], NEVER
        while token in self.halves:
            out.append((token, self.born[token], until))
            until = self.born[token]
            token = self.halves[token][side]
        return [*out, (token, -1, until)]

    def beside(self, one: int, two: int) -> bool:
        """Whether two tokens can stand side by side: no merge crosses the border in time."""
        for kept, token, side in ((self.right, one, 1), (self.left, two, 0)):
            if token not in kept:
                kept[token] = self._edge(token, side)
        get = self.merge.get
        for a, a_born, a_until in self.right[one]:
            for b, b_born, b_until in self.left[two]:
                met = get(a << 20 | b)
                # of equal merges the left comes first
                if met is not None and a_born < met < a_until and b_born < met <= b_until:
                    return False
        return True

    def step(self, state: int, byte: int) -> int:
        """The next state << 8 and the tokens more, from -128 up; made, as it isn't known."""
        trie, token_at, pairs = self.trie, self.token_at, self.pairs
        going, token, more = [], -1, 0
        for node, last, count in self.states[state]:
            node = trie[node].get(byte)
            if node is None:
                continue
            if token < 0:
                own = token_at[node]
                if own >= 0:
                    ok = last < 0
                    if not ok:
                        pair = last << 20 | own
                        ok = pairs.get(pair)
                        if ok is None:
                            ok = pairs[pair] = self.beside(last, own)
                    if ok:
                        token, more = own, count + 1
            if trie[node]:
                going.append((node, last, count))
        new = (*((node, last, count - more) for node, last, count in going), (0, token, 0))
        number = self.number.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        found = self.known[state << 8 | byte] = number << 8 | more + 128
        return found

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Classes of characters, asked of the tokenizer's own cutter where not yet known."""
        out = self.kinds[points]
        new = out == 255
        if new.any():
            for c in np.unique(points[new]).tolist():
                self.kinds[c] = self._kind(chr(c))
            out = self.kinds[points]
        return out

    def _kind(self, c: str) -> int:
        named = {" ": SPACE, "'": APOSTROPHE, "e": E, "l": L} | dict.fromkeys("stmd", SINGLE) | dict.fromkeys("rv", BEFORE_E)
        if c in named:
            return named[c]
        one = lambda text: len(self.cutter.pre_tokenize_str(text)) == 1
        # white space takes in more of its kind after it, but no letter, number or other
        return LETTER if one("a" + c) else NUMBER if one("1" + c) else OTHER if one("!" + c) else WHITE

    def counts(self, found: pa.LargeBinaryArray) -> np.ndarray:
        """Numbers of tokens of distinct pieces, read in step: at each place only the
        distinct pairs of a state and a byte are looked up."""
        if len(self.known) > MOST_STEPS:
            self.clear()
        ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
        data = np.frombuffer(found.buffers()[2], np.uint8)
        size = np.diff(ends)
        total = np.zeros(len(size), np.int64)
        order = np.argsort(-size, kind="stable")
        at = int(np.searchsorted(-size[order], -PIECE_CHUNK, "left"))
        for k in order[:at].tolist():
            total[k] = self._chained(data[ends[k] : ends[k + 1]].tobytes())
        order = order[at:]
        first, falling = ends[order], -size[order]
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        get, step = self.known.get, self.step
        for place in range(-int(falling[0]) if len(order) else 0):
            live = int(np.searchsorted(falling, -place, "left"))
            keys, which = np.unique(state[:live] << 8 | data[first[:live] + place], return_inverse=True)
            to = [get(k) for k in keys.tolist()]
            if None in to:
                to = [step(k >> 8, k & 255) if x is None else x for k, x in zip(keys.tolist(), to, strict=True)]
            to = np.array(to, np.int64)[which]
            state[:live], count[:live] = to >> 8, count[:live] + (to & 255) - 128
        total[order] = count
        return total

    def _chained(self, piece: bytes) -> int:
        """The number of tokens of a long piece from its chunks' maps."""
        chunks = [piece[at : at + PIECE_CHUNK] for at in range(0, len(piece), PIECE_CHUNK)]
        #: of each distinct chunk: what it does to the states it is entered in
        maps: dict[tuple[int, bytes], tuple[int, int]] = {}
        state, total = 0, 0
        for chunk in chunks:
            done = maps.get((state, chunk))
            if done is None:
                done = maps[state, chunk] = self._read(chunk, state)
            state, total = done[0], total + done[1]
        return total

    def _read(self, data: bytes, state: int) -> tuple[int, int]:
        count, get = 0, self.known.get
        for b in data:
            to = get(state << 8 | b)
            if to is None:
                to = self.step(state, b)
            state, count = to >> 8, count + (to & 255) - 128
        return state, count

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n_bytes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        n_tokens = np.zeros(len(texts), np.int64)
        rows, parts = np.arange(len(texts)), texts
        for name in self.special:
            # a special token's string is that token, and texts end and begin there
            split = pc.split_pattern(parts, name)
            n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(n_tokens, rows, n - 1)
            rows, parts = np.repeat(rows, n), split.flatten()
        keep = pc.greater(pc.binary_length(parts), 0)
        rows, parts = rows[keep.to_numpy(zero_copy_only=False)], parts.filter(keep)
        if not len(rows):
            return n_bytes, n_tokens
        whole = "".join(parts.to_pylist())
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        length = pc.utf8_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        kinds = np.full(len(points) + len(parts), END, np.uint8)
        text_end = np.cumsum(length + 1) - 1
        inside = np.ones(len(kinds), bool)
        inside[text_end] = False
        kinds[inside] = self.classes(points)
        begins = cuts(kinds)[inside]
        wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        starts = np.flatnonzero(begins)
        ends = np.append(0, np.cumsum(wide))
        offsets = np.append(ends[starts], ends[-1])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(whole.encode())]).dictionary_encode()
        each = self.counts(found.dictionary)[found.indices.to_numpy(zero_copy_only=False)]
        # the text of each piece, by its first character
        owner = rows[np.searchsorted(np.cumsum(length), starts, "right")]
        n_tokens += np.bincount(owner, each, len(n_tokens)).astype(np.int64)
        return n_bytes, n_tokens


def bytes_of_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Fixed values: bytes of the ranges stand for themselves, the others, in ascending
    order, for the characters from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_machines: dict[str, Machine] = {}


def machine(path: str) -> Machine:
    """The worker's machine of a vocabulary file."""
    if path not in _machines:
        _machines[path] = Machine(path)
    return _machines[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``n_tokens`` is what the tokenizers library gives for a whole text with the
    byte-level ``vocabulary`` file, without added special tokens; strings of special
    tokens in a text are those tokens. ``over_limit``: more than ``limit``. Reads doc_id
    and text; a null or empty text has no bytes and no tokens, repeated rows are counted
    alike, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(vocabulary)
        for batch in pieces_by_size(batches, 1, READ_AT_ONCE):
            n_bytes, n = own.count(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
