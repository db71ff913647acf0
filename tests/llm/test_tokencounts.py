import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwell.llm import tokencounts
from gridwell.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def path():
    return vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def theirs(tokenizer, texts):
    return [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


ALPHABET = [*"abcdefgh stmdrevl''  \n\t\r.,!?12é中 😀ÀZ\x00\x85　​́٣Ⅷ²", "'re", "'ll", "'s", " the", "ing", "<|endoftext|>", "<|endof", "AKIA"]


def test_hard_texts(tokenizer, path):
    texts = ["", " ", "   ", "\n", "it's we're they'll x'rx 'l 'lll 'r '", "  a   b \n\n c\n 's \n's  's", "<|endoftext|> a<|endoftext|>  b <|endoftext|>", "'re'rE 've'v 12'll 3'd!'s ?'s", "a" * 1000, "ab" * 3000, "привет мир 你好世界" * 200]
    assert tokencounts.Machine(path).count(pa.array(texts))[1].tolist() == theirs(tokenizer, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(ALPHABET), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join), min_size=1, max_size=5))
def test_arbitrary_texts(texts):
    path = vocabulary_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    assert tokencounts.machine(path).count(pa.array(texts))[1].tolist() == theirs(Tokenizer.from_file(path), texts)


def test_every_token_and_pairs_of_tokens(tokenizer, path):
    """Words made of tokens, which meet merges at their borders; with the states emptied in between."""
    rng = random.Random(4)
    names = [t for t in (tokenizer.decode([i]) for i in range(50256)) if t and "�" not in t]
    texts = names + ["".join(rng.choice(names).strip() for _ in range(rng.randrange(2, 5))) for _ in range(30_000)]
    own = tokencounts.Machine(path)
    for at in range(0, len(texts), 20_000):
        some = texts[at : at + 20_000]
        assert own.count(pa.array(some))[1].tolist() == theirs(tokenizer, some)
        own.clear()


def test_cuts_are_the_same_for_all_chunks():
    """The scan over chunks' maps against one pass over all characters."""
    rng = random.Random(5)
    kinds = np.array([rng.randrange(tokencounts.CLASSES) for _ in range(5000)] + [tokencounts.END], np.uint8)
    want = tokencounts.cuts(kinds, len(kinds))
    for chunk in (1, 2, 3, 64, 1000):
        assert (tokencounts.cuts(kinds, chunk) == want).all()


def test_long_texts_take_linear_time(tokenizer, path):
    rng = random.Random(6)
    own = tokencounts.Machine(path)
    texts = ["a" * 2_000_000, "ab" * 1_000_000, " " * 2_000_000, "".join(rng.choice("ACGTacgt") for _ in range(1_000_000)), "x y " * 700_000]
    began = time.process_time()
    got = own.count(pa.array(texts))[1].tolist()
    assert time.process_time() - began < 30
    short = [t[:20_000] for t in texts]
    assert own.count(pa.array(short))[1].tolist() == theirs(tokenizer, short)
    assert got[4] == 1_400_000 + 1 and got[0] > 100_000


def test_odd_rows(spark, odd, none, tokenizer, path):
    got = tokencounts.token_counts(odd, path).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    ids = [r["doc_id"] for r in odd.collect()]
    n = theirs(tokenizer, texts)
    want = [(i, len(t.encode()), k, k > 1024) for i, t, k in zip(ids, texts, n, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r[3] for r in want} == {True, False}
    assert tokencounts.token_counts(none, path).collect() == []


def test_whole_table(spark, tokenizer, texts):
    from gridwell.llm import queries

    got = {r["doc_id"]: r["n_tokens"] for r in queries.queries()["op13_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip(texts, theirs(tokenizer, [t or "" for t in texts.values()]), strict=True))
