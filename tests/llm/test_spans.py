"""Sentence spans against a version that keeps every run in a dictionary."""

import random
from collections import Counter

from helpers import empty_documents, odd_documents, prose

from attestra.llm import spans


def slow(rows, min_sentences=2, min_words=16, every_end=False):
    """Texts left per row, in the order of the rows given."""
    occurrences, pieces = {}, []
    for number, (key, text) in enumerate(rows):
        cut = spans.sentences(text or "")
        words = [tuple(s.lower().split()) for s in cut]
        pieces.append((cut, [False] * len(cut)))
        runs, n = set(), len(cut)
        for i in range(n):
            runs |= set([(i, j) for j in range(i + min_sentences, n + 1) if sum(map(len, words[i:j])) >= min_words][:1])
        for j in range(1, n + 1):
            if every_end or j == n or "\n" in cut[j - 1]:
                runs |= set([(i, j) for i in range(j - min_sentences, -1, -1) if sum(map(len, words[i:j])) >= min_words][:1])
        for i, j in runs:
            occurrences.setdefault(tuple(words[i:j]), []).append(((key is not None, key or 0), text, i, j, number))
    for found in occurrences.values():
        first = min(found, key=lambda f: (f[0], f[2], f[3]))[:4]
        for f in found:
            if f[:4] != first and not (f[0] == first[0] and f[1] == first[1] and f[2] == first[2]):
                for k in range(f[2], f[3]):
                    pieces[f[4]][1][k] = True
    return ["".join(p for p, gone in zip(*each) if not gone) for each in pieces]


def test_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]
    ends = {r["doc_id"]: r["text"] for r in spans.remove_repeated(df, every_end=True).collect()}
    assert [ends[k] for k, _ in rows] == slow(rows, every_end=True)
    got = {r["doc_id"]: r for r in spans.remove_repeated(df).collect()}
    assert [got[k]["text"] for k, _ in rows] == slow(rows)
    for key, text in rows:
        left, at = "", 0
        for begin, end in got[key]["removed_spans"]:
            left, at = left + text[at:begin], end
        assert left + text[at:] == got[key]["text"]


def test_passages(spark):
    passage = prose(77, 7)
    rows = [(k, prose(100 + k, 5) + "\n" + passage + "\n" + prose(200 + k, 5)) for k in range(6)] + [(50, prose(300, 12)), (51, "No stop here " + passage)]
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[50] == rows[6][1]
    for k in range(1, 6):
        assert got[k] == prose(100 + k, 5) + "\n" + prose(200 + k, 5)
    assert passage[len(passage) // 2:] not in got[51] and got[51].startswith("No stop here")


def test_long_sentence_without_stops(spark):
    words = prose(5, 12).replace(".", "").lower()
    rows = [(1, prose(6, 3) + words), (2, prose(7, 3) + words), (3, prose(8, 3))]
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and len(got[2]) < len(prose(7, 3)) + len(words) / 3


def test_odd_rows(spark):
    df, rows = odd_documents(spark)
    out = spans.remove_repeated(df)
    assert out.columns == [*df.columns, "removed_spans"]
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows)
    left = {}
    for r in got:
        left.setdefault(r["doc_id"], []).append(r["text"])
    assert left[1] == [prose(2, 8)] and left[6] == [""] and left[2] == [None] and left[3] == [""]
    assert left[7] == [prose(4, 9)] * 2
    again = spans.remove_repeated(out)
    assert again.columns == out.columns
    assert spans.remove_repeated(empty_documents(spark)).collect() == []


def test_tail_before_other_text(spark):
    """The last sentences of a passage, too short for a run of their own, go although text of the same line follows."""
    words = [w.lower().strip(".") for w in prose(40, 60).split()]
    passage = " ".join(" ".join(words[a:b]).capitalize() + "." for a, b in ((0, 12), (12, 19), (19, 27)))
    rows = [(k, f"{prose(500 + k, 2)} {passage} {prose(600 + k, 2)}") for k in range(12)]
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), every_end=True).collect()}
    assert got[0] == rows[0][1]
    for k in range(1, 12):
        assert got[k] == f"{prose(500 + k, 2)} {prose(600 + k, 2)}"


def test_passages_glued_to_other_words(spark):
    """Passages of 51 to 75 words at any word of a line lose at least a run wherever they stand again."""
    dice, rows = random.Random(4), []
    for k in range(40):
        passage = prose(1000 + k, 12).split()
        at = dice.randrange(10)
        passage = passage[at:at + dice.randrange(51, 76)]
        for n in range(2):
            host = prose(2000 + 2 * k + n, 12).split()
            place = dice.randrange(20, 50)
            rows.append((2 * k + n, " ".join(host[:place] + passage + host[place:]), len(passage)))
    df = spark.createDataFrame(rows, "doc_id long, text string, size long")
    lost = {r["doc_id"]: len(rows[r["doc_id"]][1].split()) - len(r["text"].split()) for r in spans.remove_repeated(df, every_end=True).collect()}
    assert all(lost[k] == 0 for k in range(0, 80, 2))
    assert all(16 <= lost[k] <= rows[k][2] for k in range(1, 80, 2))
    assert sum(lost.values()) > 0.75 * sum(r[2] for r in rows[1::2])


def test_sentences():
    text = "  Der Wert 3.14 ist?! gut.\n\n Ähnlich\u00a0wie İstanbul " + "wort " * 40 + "\u3000ende "
    cut = spans.sentences(text)
    assert "".join(cut) == text and cut[0].startswith("  Der") and not any("?! g" in s or "\nÄ" in s for s in cut)
    assert max(len(s.split()) for s in cut) <= 16 and spans.sentences("") == spans.sentences(" \n ") == []
    many = ["", "one two. three", " ", text, "x"]
    together = spans.tokens(many)
    low, high = together.edges()
    of = together.text[together.sentence[:-1]]
    assert [[t[a:b] for a, b in zip(low[of == k], high[of == k])] for k, t in enumerate(many)] == [spans.sentences(t) for t in many]


def test_runs_of_texts_together():
    """Texts tokenised together have the same runs as each alone; equal words anywhere have equal hashes."""
    texts = [prose(k, 9) + ("\n" if k % 2 else " ") + prose(99, 4) + prose(50 + k, 3) for k in range(7)]
    for every_end in (False, True):
        whole = spans.runs(spans.tokens(texts), 2, 16, every_end)
        for k, text in enumerate(texts):
            alone = spans.runs(spans.tokens([text]), 2, 16, every_end)
            assert sorted(zip(whole.h[whole.text == k], whole.place[whole.text == k])) == sorted(zip(alone.h, alone.place))
            words = {}
            for h, place in zip(alone.h, alone.place):
                span = text[place >> 32:(place >> 32) + (place & 0xFFFFFFFF)]
                bare = "".join(span.lower().split())
                assert words.setdefault(int(h), bare) == bare and len(spans.tokens([span]).first) >= 16


def test_columns_keep_their_values(spark):
    passage = prose(77, 7)
    names = ["places", "_cut", "_rid", "_key", "rid", "key", "row", "h", "cut", "text_"]
    rows = [(k, prose(100 + k, 5) + "\n" + passage, *[f"{c}{k}" for c in names]) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = sorted(spans.remove_repeated(df).collect())
    assert [tuple(r)[2:-1] for r in got] == [r[2:] for r in rows] and got[3]["text"] == prose(103, 5) + "\n"


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(k, prose(k % 5, 9) + prose(70, 5)) for k in range(12)], "doc_id long, text string")
    wanted = sorted(spans.remove_repeated(df).collect())
    monkeypatch.setattr(spans, "MARKS", 64)
    assert sorted(spans.remove_repeated(df).collect()) == wanted


def test_a_text_travels_once(spark):
    """Rows that meet their covered ranges carry the text inside the row alone, not beside it once more."""
    import re
    docs = spark.createDataFrame([(k, "one two three. four five six. " * 6) for k in range(4)], "doc_id long, text string")
    plan = spans.remove_repeated(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "row#" in plan and not re.search(r"\brow#\d+, (key#\d+L?, )?text#", plan)
