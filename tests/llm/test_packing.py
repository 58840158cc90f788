"""Packing: every id in exactly one piece, all limits kept, little padding."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import empty_documents, odd_documents
from pyspark.sql import functions as F

from attestra.llm.packing import Limits, Packer, pack_documents, pack_examples
from attestra.llm.queries import QUERIES, WORD_TOKENIZER, vocabulary
from attestra.llm.tokens import load_tokenizer


def check(rows, texts, most=2048):
    """texts: (key, text) with keys that may repeat; pieces of equal keys are told apart by their ids only."""
    tokenizer = load_tokenizer(vocabulary(WORD_TOKENIZER))
    ids = defaultdict(list)
    for key, text in texts:
        ids[key].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    wanted, found, sequences = Counter(), Counter(), defaultdict(list)
    for key, documents in ids.items():
        for own in documents:
            wanted[key] += len(own)
    for r in rows:
        found[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces = {zlib.crc32(np.array(own[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) for own in ids[r["doc_id"]] if len(own) == r["doc_tokens"]}
        assert r["ids_crc32"] in pieces
    assert found == wanted
    padding = 0
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= most
        padding += most - at
    return padding, len(sequences)


def test_query(spark, small):
    texts = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    padding, _ = check(QUERIES["op7_packing"](spark, small).collect(), texts)
    assert padding < 2048


def test_odd_rows(spark):
    df, rows = odd_documents(spark)
    got = pack_documents(df, vocabulary(WORD_TOKENIZER))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(got.collect(), rows)
    check(pack_documents(df, vocabulary(WORD_TOKENIZER), limits=Limits(64, 3, 64)).collect(), rows, 64)
    assert pack_documents(empty_documents(spark), vocabulary(WORD_TOKENIZER)).collect() == []


@pytest.mark.parametrize("cut", [True, False])
def test_limits(cut):
    random = np.random.default_rng(5)
    limits = Limits(2048, 6, 900)
    packer, out, wanted = Packer(limits, cut, 0, pool=200), [], {}
    for k in range(3000):
        length = int(random.choice([3, 60, 250, 700, 900]))
        loss = length if cut else int(length * random.random())
        wanted[k] = (length, loss)
        packer.add(k, 0, length, loss)
        out += packer.place()
    out += packer.finish()
    held = defaultdict(list)
    for name, start, length, sequence, offset in out:
        held[sequence].append((name, length, offset))
    done = Counter()
    for pieces in held.values():
        assert len(pieces) <= 6 and sum(p[1] for p in pieces) <= 2048
        assert sum(p[1] if cut else wanted[p[0]][1] for p in pieces) <= 900
        assert [p[2] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1].tolist()]
        for name, length, _ in pieces:
            done[name] += length
    assert done == {k: v[0] for k, v in wanted.items()}
    least = max(sum(v[0] for v in wanted.values()) / 2048, len(wanted) / 6, sum(v[1] for v in wanted.values()) / 900)
    assert len(held) <= 1.12 * least + 1


def test_examples(spark):
    rows = [(k, k % 700 + 1, k % 90) for k in range(2000)] + [(None, None, None), (5, 6, 5), (9000, 5000, 3), (9001, 20, 4000)]
    df = spark.createDataFrame(rows, "id long, n long, loss long").select("*", *[F.lit(0).alias(c) for c in ("k", "t", "sequence_id", "_key")])
    got = pack_examples(df, "id", "n", "loss", Limits(2048, 16, 300))
    assert got.columns == ["id", "n", "loss", "sequence_id", "offset"]
    got = got.collect()
    assert Counter(r["id"] for r in got) == Counter(r[0] for r in rows)
    assert {r["id"] for r in got if r["sequence_id"] is None} == {9000, 9001}
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append(r)
    for sequence, pieces in held.items():
        if sequence is not None:
            assert sum(p["n"] for p in pieces) <= 2048 and len(pieces) <= 16 and sum(p["loss"] for p in pieces) <= 300
    assert pack_examples(df.limit(0), "id", "n", "loss").collect() == []


@pytest.mark.parametrize("text", ["one two three", ""])
def test_many_short_texts_leave_little_padding(spark, text):
    rows = [(k, text) for k in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    padding, sequences = check(pack_documents(df, vocabulary(WORD_TOKENIZER)).collect(), rows)
    assert padding < 2048 and sequences > 1


def test_runs_without_search_have_the_ids_of_the_file():
    """Runs of letters and marks go past the normaliser and the pattern of the file and have the ids that these give."""
    import public_tokenizers
    from attestra.llm.tokens import load_tokenizer, run_tokenizer, runs_of
    path = public_tokenizers.path("word_bpe_49k.json")
    words = ["Hello", "CHÈQUE!!", "(straße)", "ÑÿÀ", "a_b{c}~", "###", "x"]
    runs = [r for w in words for r in runs_of(w)]
    assert run_tokenizer(path).encode(" ".join(runs)).ids == load_tokenizer(path).encode(" ".join(words), add_special_tokens=False).ids
    assert [runs_of(w) for w in ("don't", "a1", "<|endoftext|>", "µ", "Ÿ", "a\u0301", "")] == [None] * 7
