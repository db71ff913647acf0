"""The encoder against the tokenizer, and sets of shingles against plain sets."""

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridwell.llm import text

PATHS = {"byte_bpe_50k.json": False, "word_bpe_49k.json": True}
PARTS = ["a", "the", "Word", "don't", "it's", "'ll", "é", "İ", "ß", "中文", "Σ", "ǅ", "²", "½", "12", "3", ".", ",", "!?", "--", "<|endoftext|>", "<|startoftext|>", "<|", "</w>", "\x00", "\x1c", "\u0301", "x" * 250]
SPACES = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", "\u2003", "\u3000", ""]
TEXTS = st.lists(st.tuples(st.sampled_from(PARTS) | st.text(max_size=6), st.sampled_from(SPACES)), max_size=25).map(lambda xs: "".join(a + b for a, b in xs))


@pytest.mark.parametrize("name", PATHS)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(TEXTS | st.none(), max_size=6))
def test_ids_are_the_tokenizers(name, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    got = text.encoder(public_tokenizers.path(name), PATHS[name]).encode(texts)
    assert [x.tolist() for x in got] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", PATHS)
def test_ids_of_whole_documents(name, texts, monkeypatch):
    """With words and copies in blocks of a few."""
    monkeypatch.setattr(text, "_AT_ONCE", 100)
    monkeypatch.setattr(text, "_COPIED_AT_ONCE", 37)
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    some = list(texts.values())[:60]
    got = text.encoder(public_tokenizers.path(name), PATHS[name]).encode(some)
    assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in some]


def test_shingle_sets_are_as_large_as_plain_sets(texts):
    some = [*texts.values(), None, "", " \n", "a", "A b c", "a B c", "a b c d e", "x " * 40]
    got = text.shingle_sets(pa.array(some))
    plain = []
    for t in some:
        words = text.space_words(t)
        plain.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    assert list(map(len, got)) == list(map(len, plain))
    for i in range(0, len(some) - 1, 7):
        assert len(set(got[i].tolist()) & set(got[i + 1].tolist())) == len(plain[i] & plain[i + 1])
    assert got[-4].tolist() == got[-3].tolist() and len(got[-1]) == 1


@pytest.mark.parametrize(("name", "lower"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_every_latin_character_in_every_place(name, lower):
    """All code points below U+0250 at the start, in the middle and at the end of words."""
    from tokenizers import Tokenizer

    from gridwell.llm.queries import vocabulary_path
    from gridwell.llm.text import Encoder

    path = vocabulary_path(name)
    chars = [chr(c) for c in range(0x250)]
    texts = [t for c in chars for t in (f"one {c}sas two", f"qa{c}nun", f"ab{c} x", f"{c}{c.upper()}{c.lower()}")]
    texts += ["Əsas qanun", "Ɛwe Ɔkyerɛ", "Ɓala ƊAN", "Azərbaycan Respublikasının Əsas Qanunu"]
    t = Tokenizer.from_file(path)
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in Encoder(path, lower).encode(texts)] == want
