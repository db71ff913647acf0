import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridwell.llm import tokenstore

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(docs):
    tok = Tokenizer.from_file(PATH)
    out, at = [], 0
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_round_trip_in_order(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    files = tokenstore.write(docs, PATH)
    got = tokenstore.read(spark, files).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(sorted(texts.items()))


def test_short_access_and_hash(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    files = tokenstore.write(docs, PATH)
    known = tokenstore.dictionaries(spark, files)
    tok = Tokenizer.from_file(PATH)
    block = spark.read.parquet(f"{files.path}/blocks").first()["block"]
    entries = tokenstore.index(bytes(block), known)[0]
    doc_id = int(entries["doc_id"][len(entries) // 2])
    assert tokenstore.document(bytes(block), known, doc_id).tolist() == [*tok.encode(texts[doc_id], add_special_tokens=False).ids, 2]
    with pytest.raises(KeyError):
        tokenstore.index(bytes(block), {})


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = tokenstore.read(spark, tokenstore.write(odd, PATH)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r[0], r[2], r[3]) for r in got), key=key) == sorted(((r[0], r[2], r[3]) for r in expected(rows)), key=key)
    assert tokenstore.read(spark, tokenstore.write(none, PATH)).collect() == []


def test_smallest_id_is_no_null(spark):
    docs = spark.createDataFrame([(-(1 << 63), "one two"), (None, "three"), (0, "four"), (5, "")], "doc_id long, text string")
    files = tokenstore.write(docs, PATH)
    got = tokenstore.read(spark, files, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -(1 << 63), 0, 5]
    known = tokenstore.dictionaries(spark, files)
    zero = Tokenizer.from_file(PATH).encode("four", add_special_tokens=False).ids
    for r in spark.read.parquet(f"{files.path}/blocks").collect():
        entries = tokenstore.index(bytes(r["block"]), known)[0]
        if 0 in entries["doc_id"][entries["known"] == 1]:
            assert tokenstore.document(bytes(r["block"]), known, 0).tolist() == [*zero, 2]


def test_parts_by_size_in_groups(spark, texts, monkeypatch):
    monkeypatch.setattr(tokenstore, "PART_BYTES", 4000)
    monkeypatch.setattr(tokenstore, "PARTS_IN_A_GROUP", 3)
    files = tokenstore.write(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH)
    parts = spark.read.parquet(f"{files.path}/parts").count()
    assert parts > 30
    got = tokenstore.read(spark, files).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(sorted(texts.items()))
