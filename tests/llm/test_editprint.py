"""Edit fingerprints: a step-by-step walk, the next document in order, near copies against all pairs."""

import hashlib
from collections import Counter

import numpy as np
from helpers import empty_documents, odd_documents, prose
from pyspark.sql import functions as F

from attestra.llm import editprint
from attestra.llm.queries import QUERIES


def slow_fingerprint(text):
    """Writes the embedded string step by step and reads the sampled places."""
    kinds, written, i, phase = editprint.classes(text), [], 0, 0
    while i < len(kinds):
        written.append(kinds[i])
        i += bool(editprint._moves[kinds[i], phase])
        phase = (phase + 1) % editprint.PERIOD
    if not written:
        return "00" * (editprint.BITS // 8)
    places = [max(p for p in row if p < len(written)) for row in editprint.RECORDS.tolist()]
    return np.packbits([editprint.BIT[k, written[p]] for k, p in enumerate(places)]).tobytes().hex()


def test_walk():
    for text in ("", "a", "ab" * 300, prose(1, 40), "漢字 and ünïcode " * 20, "\x00" * 1000):
        assert editprint.fingerprint(text).tobytes().hex() == slow_fingerprint(text)


def test_likeness():
    base = prose(3, 60)
    print_ = editprint.fingerprint(base)
    edited = base[:700] + "a few inserted words " + base[700:1500] + base[1530:]
    assert editprint.likeness(print_, print_) == 1.0
    assert editprint.likeness(print_, editprint.fingerprint(edited)) > 0.6
    assert editprint.likeness(print_, editprint.fingerprint(prose(4, 60))) < 0.35


def check(rows, texts):
    """texts in the order of the documents."""
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in rows)
    wanted = Counter()
    for k, (key, text) in enumerate(texts):
        text, after = text or "", texts[(k + 1) % len(texts)][1] or ""
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        own, other, new = (editprint.fingerprint(t) for t in (text, after, edited))
        wanted[key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes().hex(), new.tobytes().hex(),
               editprint.likeness(own, new), editprint.likeness(own, other)] += 1
    assert got == wanted


def test_query(spark, small, monkeypatch):
    texts = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    check(QUERIES["op10_edit_fingerprint"](spark, small).collect(), texts)
    monkeypatch.setattr(editprint, "RANGE_BYTES", 2000)
    got = QUERIES["op10_edit_fingerprint"](spark, small).collect()
    check(got, texts)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got if r["n_chars"] > 200]) > 0.95


def test_odd_rows(spark, monkeypatch):
    df, _ = odd_documents(spark)
    ordered = df.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "text")
    texts = [tuple(r) for r in ordered.collect()]
    for size in (1 << 22, 300):
        monkeypatch.setattr(editprint, "RANGE_BYTES", size)
        out = editprint.compare_with_edits(df)
        assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        check(out.collect(), texts)
    one = df.where("doc_id = 1")
    check(editprint.compare_with_edits(one).collect(), [tuple(r) for r in one.select("doc_id", "text").collect()])
    assert editprint.compare_with_edits(empty_documents(spark)).collect() == []


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(editprint, "TILE_ROWS", 4)
    bases = [prose(50 + k, 30) for k in range(6)]
    rows = [(10 * k + j, b[:200 * j + 100] + "!" * j + b[200 * j + 100:]) for k, b in enumerate(bases) for j in range(8)] + [(900, ""), (901, None), (950, bases[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"]) for r in editprint.near_copies(df).collect())
    rows.sort()
    prints = [editprint.fingerprint(t or "") for _, t in rows]
    names = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if editprint.likeness(prints[a], prints[b]) >= 0.8:
                low, high = sorted((names[a], names[b]))
                names = [low if n == high else n for n in names]
    assert got == Counter((rows[k][0], rows[n][0]) for k, n in enumerate(names))
    assert len(set(names)) < 15
    assert editprint.near_copies(empty_documents(spark)).collect() == []
