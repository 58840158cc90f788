"""Spelling variants: trie numbering, neighbours and chains against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import empty_documents, odd_documents
from pyspark.sql import functions as F

from attestra.llm import variants as v
from attestra.llm.common import tabled
from attestra.llm.queries import QUERIES


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows, every=31):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    shapes = defaultdict(set)
    for w in n:
        for shape in {w} | {w[:k] + w[k + 1:] for k in range(len(w))}:
            shapes[shape].add(w)
    beside = {w: sorted({u for s in {w} | {w[:k] + w[k + 1:] for k in range(len(w))} for u in shapes[s] if near(w, u)}, key=lambda u: (-n[u], u)) for w in n}
    form = {w: us[0] if us and n[us[0]] >= 10 * n[w] else None for w, us in beside.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(beside[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def answer(df, **kw):
    return sorted(tuple(r) for r in v.variants(df, **kw).collect())


@pytest.mark.parametrize("size", [7, 1 << 17])
def test_trie_and_neighbours(spark, monkeypatch, size):
    """Equal prefixes have one node and others another, over any number of ranges; all words over few letters."""
    monkeypatch.setattr(v, "SORTED_WORDS", size)
    dice = random.Random(3)
    words = sorted({"".join(dice.choice("aé") for _ in range(dice.randrange(1, 9))) for _ in range(140)})
    df = tabled(spark.createDataFrame([(w, dice.randrange(2, 40)) for w in words], "word string, n long"))
    n = {r["word"]: r["n"] for r in df.collect()}
    for backwards in (False, True):
        rows = v.trie_nodes(df, backwards).collect()
        turned = lambda w: w[::-1] if backwards else w
        node = {}
        for r in rows:
            assert len(r["nodes"]) == len(r["word"]) + 1
            for depth, number in enumerate(r["nodes"]):
                assert node.setdefault(turned(r["word"])[:depth], number) == number
        assert len(set(node.values())) == len(node)
        assert [r["word"] for r in sorted(rows, key=lambda r: r["number"])] == sorted(words, key=turned)
    numbered = tabled(v.trie_nodes(df, False).join(df, "word"))
    number = {r["word"]: r["number"] for r in numbered.collect()}
    wanted = {}
    for a in words:
        if beside := [b for b in words if near(a, b)]:
            best = min(beside, key=lambda b: (-n[b], b))
            wanted[number[a]] = (len(beside), n[best], -number[best])
    assert {r["number"]: (r["n_near"], *r["best"]) for r in v.neighbours(numbered).collect()} == wanted


def test_inherited_nodes_over_many_ranges():
    """A prefix that fills whole ranges keeps the node of the range it began in."""
    ends = [(0, "aa", "abx"), (1, "aby", "abz"), (2, "abzz", "abzzz"), (4, "ac", "b"), (5, "c", "c")]
    got = v.inherited(ends)
    tail = lambda part, depth: (part + 1 << 40) | 1 << 39 | depth
    assert got == {1: [tail(0, 1), tail(0, 2)], 2: [tail(0, 1), tail(0, 2), tail(1, 3)], 4: [tail(0, 1)], 5: []}


def test_chains_and_ties(spark, monkeypatch):
    monkeypatch.setattr(v, "SORTED_WORDS", 3)
    words = {"abcdefg": 1000, "abcdefh": 100, "abcdeh": 50, "abcdehh": 10, "abcdfhh": 2, "zbcdefg": 1000, "xbcdefg": 100, "aabbccdd": 20, "abbccdd": 2, "aabbcccdd": 2, "lonely": 9, "solitary": 2,
             "ÀBcdefgh": 30, "àbcdefgh": 3}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items())]
    got = answer(spark.createDataFrame(rows, "doc_id long, text string"), every=10 ** 9)
    assert got == brute(rows, 10 ** 9)
    found = {r[0]: r for r in got}
    assert found["xbcdefg"][1] == "abcdefg" and found["abcdfhh"][2] == "abcdfhh" and found["abbccdd"][1] == found["aabbcccdd"][1] == "aabbccdd"
    assert found["abcdefh"][2] == "abcdefg" and "Àbcdefgh" in found


def test_odd_rows(spark):
    df, rows = odd_documents(spark)
    extra = [(20, "Straßenbahn straßenbahn STRAßENBAHN Straßenbahm straßenbahm×÷x"), (21, "q" * 5000 + " " + "q" * 4999 + " " + "q" * 5000 + " " + "q" * 4999), (None, "nullkeys " * 40)]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    both = df.select("doc_id", "text").unionByName(more)
    wanted = brute([*rows, *extra])
    assert answer(both) == wanted and len(wanted) > 5
    clash = both.select("*", *[F.lit(0).alias(c) for c in ("word", "n", "name", "number", "nodes", "before", "after", "root", "form")])
    assert answer(clash) == wanted
    assert answer(empty_documents(spark)) == []
    assert answer(spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id long, text string")) == []


def test_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op13_variants"](spark, small).collect())
    assert got == brute(rows) and len(got) > 100
