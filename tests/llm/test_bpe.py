"""Token ids and decoded texts against the tokenizers library."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import empty_documents, odd_documents

from attestra.llm import bpe
from attestra.llm.queries import BYTE_TOKENIZER, WORD_TOKENIZER, QUERIES, vocabulary
from attestra.llm.tokens import WordEncoder, load_tokenizer

TEXTS = ["a<|endoftext|>b  <|endoftext|> c", "  x", "\n\n y\t\tz  ", "a　b\x85c \x1c d", "", " ", "it's  we'LL\r\n\r\n 12345", "é É ﬁ ǅ İ", "<|", "x <| y <|endoftext|", "​ 　q"]


def test_words_give_the_ids_of_the_text():
    byte, word = load_tokenizer(vocabulary(BYTE_TOKENIZER)), load_tokenizer(vocabulary(WORD_TOKENIZER))
    specials = bpe._special_pattern(vocabulary(BYTE_TOKENIZER))
    for text in TEXTS:
        words = bpe.split_words(text, specials)
        assert "".join(words) == text
        ids = [k for raw in bpe.encode_words(byte, words) for k in np.frombuffer(raw, "<u4").tolist()]
        assert ids == byte.encode(text, add_special_tokens=False).ids
    more = TEXTS + ["Über-Straße!! ÀÉ,é«x» don't a_b [x] {y}| ~`^ 1a2 x² ªº ß.ÿ", "'s x's '' \" $1.5% <|x|> a<|endoftext|>", "e\u0301 o\u0308x \u00d7\u00f7 \u0130 \u03a3\u03c3\u03c2"]
    for text, raw in zip(more, WordEncoder(vocabulary(WORD_TOKENIZER)).encode(more)):
        assert np.frombuffer(raw, "<u4").tolist() == word.encode(text, add_special_tokens=False).ids


def test_places():
    for places in (np.zeros(0, np.uint32), np.arange(70_000, dtype=np.uint32), np.array([5], np.uint32)):
        assert np.array_equal(bpe.unpack_places(bpe.pack_places(places)), places)


def test_query(spark, small):
    tokenizer = load_tokenizer(vocabulary(BYTE_TOKENIZER))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op4_bpe"](spark, small).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = tokenizer.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("chars", [10, 1 << 20])
def test_odd_rows(spark, monkeypatch, chars):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", chars)
    path = vocabulary(BYTE_TOKENIZER)
    df, rows = odd_documents(spark)
    got = bpe.encode_and_decode(df, path).collect()
    wanted = [(k, tuple(load_tokenizer(path).encode(t or "", add_special_tokens=False).ids), t or "") for k, t in rows]
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == Counter(wanted)
    assert bpe.encode_and_decode(empty_documents(spark), path).collect() == []


def test_decode(spark):
    path = vocabulary(BYTE_TOKENIZER)
    tokenizer = load_tokenizer(path)
    rows = [(k, tokenizer.encode(t, add_special_tokens=False).ids) for k, t in enumerate(TEXTS)]
    got = {r["k"]: r for r in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), ["k"], "ids", path).collect()}
    for k, ids in rows:
        if ids:
            assert got[k]["ids"] == ids and bytes(got[k]["decoded"]).decode() == tokenizer.decode(ids, skip_special_tokens=False)
    assert set(got) == {k for k, ids in rows if ids}
