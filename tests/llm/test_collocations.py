"""Collocations: automata against plain counts, and all phrases against brute force over many ranges and shards."""

import random
import re
from collections import Counter

import pytest
from helpers import empty_documents, odd_documents
from pyspark.sql import functions as F

from attestra.llm import collocations as c
from attestra.llm.queries import QUERIES


def grams(texts):
    out = Counter()
    for text in texts:
        for piece in re.split(rb"[.,;:!?\n-\r]", text.encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            out.update(tuple(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    return out


def brute(rows, least=10, first=2000):
    out = []
    langs = {}
    for text, lang in rows:
        langs.setdefault("und" if lang is None else lang, []).append(text or "")
    for lang, texts in langs.items():
        f = grams(texts)
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longer = Counter()
        for g, a in often.items():
            for part in (g[:2], g[1:]) if len(g) == 3 else ():
                longer[part] = max(longer[part], a)
        found = []
        for g, a in often.items():
            if 100 * longer[g] < 50 * a:
                score, k = min((10 ** 6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, b" ".join(g), f[g[:k]], f[g[k:]]))
        n = sum(a for g, a in f.items() if len(g) == 1)
        out += [(lang, k, g.decode(), -a, l, r, n, -s) for k, (s, a, g, l, r) in enumerate(sorted(found)[:first], 1)]
    return sorted(out, key=repr)


def flat(automaton):
    return {tuple(automaton.words[i] for i in g): int(w) for *columns, weights in automaton.grams() for *g, w in zip(*columns, weights) if w}


def test_automata():
    dice = random.Random(1)
    words = ["a", "b", "cc", "dé", "e\x01", "zz", "\x00x", "A"]
    for _ in range(150):
        text = lambda: "".join(dice.choice(words) + dice.choice([" ", "  ", "\t", ". ", "\n"]) for _ in range(dice.randrange(0, 40)))
        shards = [[text() for _ in range(dice.randrange(0, 4))] for _ in range(3)]
        built = [c.shard([t.encode() for t in texts]) for texts in shards]
        for one, texts in zip(built, shards):
            assert flat(one) == flat(c.decode(c.encode(one))) == dict(grams(texts))
        whole = grams(sum(shards, []))
        bounds = sorted(dice.sample(sorted(whole), min(len(whole), dice.randrange(0, 6))))
        ranges = {}
        for one in built:
            for k, part in c.slices(one, bounds):
                ranges.setdefault(k, []).append(c.decode(c.encode(part)))
        got = {}
        for k, parts in ranges.items():
            own = flat(c.union(parts))
            assert all((k == 0 or bounds[k - 1] <= g) and (k == len(bounds) or g < bounds[k]) for g in own)
            assert not set(got) & set(own)
            got |= own
        assert got == dict(whole)


def test_states_are_shared():
    one = c.shard(b". ".join(b"%s x y. %s x z" % (w, w) for w in (b"a", b"b", b"d")).split(b"\n"))
    shared, apart = len(c.encode(one)), len(c.encode(c.shard([b"a x y. a x z. b x y. b x w. d x y. d x v"])))
    assert shared < apart


@pytest.mark.parametrize("size", [None, 400])
def test_phrases(spark, monkeypatch, size):
    """Whole reports; with small shards and ranges every phrase crosses many of both."""
    if size:
        for name, value in (("SHARD_BYTES", 3 * size), ("RANGE_BYTES", 2 * size), ("RANGE_PHRASES", 9)):
            monkeypatch.setattr(c, name, value)
    dice = random.Random(4)
    words = "the The of cat Ähre ähre x y z it's \x00 q\x85r 漢字".split(" ")
    text = lambda: " ".join(dice.choices(words, [20, 1, 9, 5, 5, 4, 3, 3, 3, 2, 1, 1, 2])[0] + dice.choice(["", "", "", "", ".", ",", "\n", "\t"]) for _ in range(dice.randrange(1, 60)))
    rows = [(text(), dice.choice(["en", "en", "en", "de", None, "", "en\x01"])) for _ in range(260)] + [("hot pair hot pair hot pair", "en")] * 90
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    for least, first in ((10, 2000), (3, 7)):
        got = sorted((tuple(r) for r in c.collocations(df, least=least, first=first).collect()), key=repr)
        assert got == brute(rows, least, first) and len(got) > 20


def test_exact_scores(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    big = 3_000_000_019
    grams = [("en", "a b", 2, big), ("en", "a", 1, big + 2), ("en", "b", 1, big + 4), ("en", "c d", 2, big), ("en", "c", 1, big), ("en", "d", 1, big), ("en", None, 0, 9 * big)]
    monkeypatch.setattr(c, "counted", lambda rows, least: spark.createDataFrame(grams, "lang string, phrase string, size int, f long"))
    got = {r["phrase"]: tuple(r)[3:] for r in c.collocations(spark.createDataFrame([], "text string, lang string")).collect()}
    assert got["a b"] == (big, big + 2, big + 4, 9 * big, 10 ** 6 * big * big // ((big + 2) * (big + 4)))
    assert got["c d"] == (big, big, big, 9 * big, 10 ** 6)


def test_odd_rows(spark):
    df, rows = odd_documents(spark)
    df = df.select("*", *[F.lit("x").alias(n) for n in ("phrase", "automaton", "part", "f", "size")])
    got = sorted((tuple(r) for r in c.collocations(df, least=2, first=None).collect()), key=repr)
    assert got == brute([(t, "en") for _, t in rows], 2, None) and got
    assert c.collocations(empty_documents(spark)).collect() == []
    long = spark.createDataFrame([("w" * 300_000 + " v " * 30, None), (None, None)], "text string, lang string")
    assert [tuple(r)[:4] for r in c.collocations(long).collect()] == [("und", 1, "v v v", 28)]


def test_query(spark, small):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_collocations"](spark, small).collect()), key=repr) == brute(rows)
