"""Distributed jobs against plain Python on small data, with one hot key."""

import difflib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from attestra.operators import assembly as A
from attestra.operators import graphs as G
from attestra.operators import intervals as I
from attestra.operators import lines as L
from attestra.operators import manufacturing as M
from attestra.operators import ordered as O
from attestra.operators import outcome as Out
from attestra.operators import permits as P
from attestra.operators import reports as Rep
from attestra.operators import retrieval as K
from attestra.operators import rules as R
from attestra.operators.rules import Rule
from attestra.session import cut_lineage


@pytest.fixture(scope="module")
def events(spark):
    """One key holds most rows and spans many blocks."""
    rnd = random.Random(3)
    rows = [("hot", i, rnd.choice([None, i])) for i in range(900)] + [("cold", i * 50, None if i % 3 else i) for i in range(40)]
    return spark.createDataFrame(rows, "k string, pos long, v long").repartition(7).withColumn("block", O.block_of(F.col("pos"), 64))


def _same(a, b, columns):
    assert sorted(map(tuple, a.select(*columns).collect()), key=repr) == sorted(map(tuple, b.select(*columns).collect()), key=repr)


def test_blockwise_equals_plain_windows(events):
    w = Window.partitionBy("k").orderBy("pos")
    plain = events.withColumns({"last": F.last("v", ignorenulls=True).over(w), "n": F.row_number().over(w), "prev": F.lag("v").over(w), "next": F.lead("v").over(w),
                                "total": F.sum(F.coalesce("v", F.lit(0))).over(w)})
    mine = O.running_last(events, ["k"], "block", ["pos"], F.col("v"), "last")
    _same(mine, plain, ["k", "pos", "last"])
    _same(O.row_numbers(events, ["k"], "block", ["pos"], "n"), plain, ["k", "pos", "n"])
    _same(O.neighbour(events, ["k"], "block", ["pos"], F.col("v"), "prev"), plain, ["k", "pos", "prev"])
    _same(O.neighbour(events, ["k"], "block", ["pos"], F.col("v"), "next", following=True), plain, ["k", "pos", "next"])
    _same(O.running_sum(events, ["k"], "block", ["pos"], F.coalesce("v", F.lit(0)), "total"), plain, ["k", "pos", "total"])


def test_range_blocks_split_the_hot_key(events):
    blocks = O.range_blocks(events.drop("block"), ["k"], ["pos"], parts=6)
    assert blocks.where("k = 'hot'").select("block").distinct().count() > 2
    plain = events.withColumn("prev", F.lag("pos").over(Window.partitionBy("k").orderBy("pos")))
    _same(O.neighbour(blocks, ["k"], "block", ["pos"], F.col("pos"), "prev"), plain, ["k", "pos", "prev"])


def _brute_tfidf(corpus, questions, terms):
    counts = {d: Counter(terms(t)) for d, t in corpus}
    df = Counter(x for c in counts.values() for x in c)
    idf = {x: math.log((1 + len(corpus)) / (1 + n)) + 1 for x, n in df.items()}

    def unit(c):
        v = {x: n * idf[x] for x, n in c.items() if x in idf}
        norm = math.sqrt(sum(w * w for w in v.values())) or 1.0
        return {x: w / norm for x, w in v.items()}
    docs = {d: unit(c) for d, c in counts.items()}
    return {(q, d): sum(w * v.get(x, 0.0) for x, w in unit(Counter(terms(t))).items()) for q, t in questions for d, v in docs.items()}


def _words(text):
    ws = text.split()
    return ws + [a + " " + b for a, b in zip(ws, ws[1:])]


def _pieces(text):
    out = []
    for word in text.split():
        p = f" {word} "
        for n in (2, 3, 4, 5):
            out.extend(p[i:i + n] for i in range(max(len(p) - n + 1, 1)))
            if len(p) <= n:
                break
    return out


@pytest.mark.parametrize("share", [0.02, 0.3, 2.0])
def test_search_equals_brute_force(spark, share):
    rnd = random.Random(5)
    vocabulary = ["the", "of", "a"] * 12 + [f"w{i}" for i in range(60)]
    corpus = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 30)))) for i in range(120)]
    corpus += [(200 + i, corpus[3][1]) for i in range(3)]
    questions = [(i, " ".join(rnd.choices(vocabulary, k=8))) for i in range(6)] + [(9, "unknownword"), (10, "the of")]
    got = K.search(spark.createDataFrame(corpus, "doc long, text string"), spark.createDataFrame(questions, "query long, text string"), k=5, common_share=share)
    got = {(r["query"], r["rank"]): (r["doc"], round(r["score"], 9)) for r in got.collect()}
    a, b = _brute_tfidf(corpus, questions, _words), _brute_tfidf(corpus, questions, _pieces)
    want = {}
    for q, _ in questions:
        ranked = sorted(((round(0.65 * a[q, d] + 0.35 * b[q, d], 9), d) for d, _ in corpus), key=lambda x: (-x[0], x[1]))
        want.update({(q, i + 1): (d, s) for i, (s, d) in enumerate(ranked[:5]) if s > 0})
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_search_in_many_blocks_and_ranges(spark):
    """Terms of several blocks and ranges, more than one share of questions, odd letters and words that a text repeats."""
    rnd = random.Random(6)
    vocabulary = ["the", "of", "a"] * 9 + ["가나다", "é𝒳z", "x"] * 3 + [f"w{i}" for i in range(50)]
    corpus = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 30)))) for i in range(90)]
    questions = [(i, " ".join(rnd.choices(vocabulary, k=8))) for i in range(5)] + [(9, "unknownword")]
    frames = spark.createDataFrame(corpus + [(500, None)], "doc long, text string"), spark.createDataFrame(questions, "query long, text string")
    # the text that is null counts as a document
    for words, chars, terms in ((True, False, _words), (False, True, _pieces)):
        brute = _brute_tfidf(corpus + [(500, "")], questions, terms)
        got = K.search(*frames, k=4, words=words, chars=chars, block_bytes=4000, range_bytes=1000).collect()
        want = {}
        for q, _ in questions:
            ranked = sorted(((round(brute[q, d], 9), d) for d, _ in corpus), key=lambda x: (-x[0], x[1]))
            want.update({(q, i + 1): (d, s) for i, (s, d) in enumerate(ranked[:4]) if s > 0})
        assert {(r["query"], r["rank"]): r["doc"] for r in got} == {k: v[0] for k, v in want.items()}
        assert all(abs(r["score"] - want[r["query"], r["rank"]][1]) < 1e-8 for r in got)


def test_search_stores_no_terms_of_documents(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(K, "shared_folder", lambda spark: str(tmp_path))
    corpus = spark.range(300).selectExpr("id as doc", "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', id * 60 + i))) as text")
    K.search(corpus, spark.createDataFrame([(1, "w1 w2 nowhere")], "query long, text string"), k=3).collect()
    stored = [spark.read.parquet(str(p)) for p in tmp_path.glob("search-*/df")]
    # w1, w2, their pair and pieces, of 36,000 terms and more
    assert len(stored) == 1 and sum(df.where("term is not null").count() for df in stored) < 60


def test_containing_pairs_equal_all_pairs(spark):
    rnd = random.Random(1)
    left = sorted({"".join(rnd.choices("abc", k=rnd.randint(1, 12))) for _ in range(80)})
    right = sorted({"".join(rnd.choices("abc", k=rnd.randint(1, 10))) for _ in range(80)})
    got = P.containing_pairs(spark.createDataFrame([(1, x) for x in left], "g int, a string"), spark.createDataFrame([(1, x) for x in right], "g int, b string"), "g", "a", "b")
    assert {(r["a"], r["b"]) for r in got.collect()} == {(a, b) for a in left for b in right if a in b or b in a}


def test_containing_pairs_of_small_and_large_groups(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choices("abc", k=rnd.randint(1, n)))
    left = [(g, word(9)) for g in (1, 2, 3) for _ in range(3 if g < 3 else 200)] + [(4, "ab"), (None, "a"), (1, "")]
    right = [(g, word(9)) for g in (1, 2, 3) for _ in range(2 if g != 2 else 150)] + [(5, "ab"), (None, "a"), (1, "")]
    got = P.containing_pairs(spark.createDataFrame(left, "g int, a string"), spark.createDataFrame(right, "g int, b string"), "g", "a", "b").collect()
    want = {(g, a, b) for g, a in left for h, b in right if g is not None and g == h and a and b and (a in b or b in a)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def _broadcasts(df) -> bool:
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_stages_send_no_names_through_the_driver(spark):
    # a small file of constant names is estimated far below its rows and pieces
    labels, stages = spark.range(50).selectExpr("id as doc_id", "'원액 시험' as label"), spark.range(50).selectExpr("id as doc_id", "'원액' as stage", "0 as position")
    pairs = P.containing_pairs(labels, stages, "doc_id", "label", "stage")
    assert not _broadcasts(pairs) and pairs.count() == 50


def test_stage_counts_send_no_names_through_the_driver(spark):
    rows = spark.range(50).selectExpr("id as doc_id", "'원액 시험' as title", "'1.2' as section_number", "'원액' as context", "'PASS' as status")
    counts = Rep.stage_counts(rows, spark.range(50).selectExpr("id as doc_id", "'원액' as stage", "'1' as number", "0 as position"))
    assert not _broadcasts(counts) and counts.where("stage = '원액' and total = 1").count() == 50


def test_diagram_consistency_sends_no_names_through_the_driver(spark):
    nodes = spark.range(50).selectExpr("id as doc_id", "'n' as node_id", "'원액' as name", "map('제조량', '5 L') as fields")
    body = spark.range(50).selectExpr("id as doc_id", "'2.1 원액 공정' as section_title", "'제조량 | 5 L' as content")
    checks = R.diagram_consistency(nodes, body, Rule("A.7", "diagram_consistency", {}, {"field": "제조량"}))
    assert not _broadcasts(checks) and checks.where("status = 'PASS'").count() == 50


def test_fuzzy_stages_equal_brute_force(spark):
    labels = ["CHO 마스터 세포주 시험", "E.colli 제조용세포주", "Component B 원액", "최종원액", "나노피티클 원액", "무관한 것", "완제"]
    stages = ["CHO 마스터세포주", "E. coli 제조용 세포주", "컴포넌트 A 중간체 원액", "컴포넌트 B 중간체 원액", "최종 원액", "완제 의약품", "나노 파티클"]
    got = M.fuzzy_stages(spark.createDataFrame([("d", x) for x in labels], "doc_id string, label string"),
                         spark.createDataFrame([("d", x, i) for i, x in enumerate(stages)], "doc_id string, stage string, position int"))
    got = {r["label"]: (r["stage"], round(r["score"], 6)) for r in got.collect()}
    key = {x: spark.range(1).select(M.stage_key(F.lit(x))).first()[0] for x in labels + stages}

    def score(a, b):
        import re
        if a == b:
            return 1.0
        if len(a) >= 4 and len(b) >= 4 and (a in b or b in a):
            return 0.95
        ta, tb = ({w for w in M.STAGE_TERMS if w in x} for x in (a, b))
        s = 0.45 * difflib.SequenceMatcher(None, a, b).ratio() + (0.55 * len(ta & tb) / len(ta | tb) if ta | tb else 0)
        ca, cb = (re.search("component([a-z0-9]+)", x) for x in (a, b))
        if ca and cb:
            s += 0.2 if ca[1] == cb[1] else -0.45
        return max(0.0, min(1.0, s if ta & tb else min(s, 0.42)))
    for label in labels:
        best = max(((score(key[label], key[s]), -i, s) for i, s in enumerate(stages)))
        assert got.get(label) == ((best[2], round(best[0], 6)) if best[0] >= 0.55 else None)


def test_layers_and_cycles(spark):
    nodes = spark.createDataFrame([("a", i) for i in range(6)] + [("c", i) for i in range(4)], "doc_id string, node_id int")
    edges = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 0, 2), ("a", 2, 3), ("a", 5, 3), ("c", 0, 1), ("c", 1, 2), ("c", 2, 1), ("c", 2, 3)], "doc_id string, src int, dst int")
    got = {(r["doc_id"], r["node_id"]): (r["layer"], r["cyclic"]) for r in G.layers(nodes, edges, checkpoint_every=2).collect()}
    assert [got["a", i] for i in range(6)] == [(0, False), (1, False), (2, False), (3, False), (0, False), (0, False)]
    assert all(got["c", i] == (None, True) for i in range(4))


def test_long_cycles_end_at_once(spark, monkeypatch):
    """A ring of 2,000 nodes stalls in the first round; a ring behind a chain after the chain; ends that are no nodes do not count."""
    rounds = []
    monkeypatch.setattr(G, "cut_lineage", lambda df: rounds.append(1) or cut_lineage(df))
    nodes = spark.createDataFrame([("ring", i) for i in range(2000)] + [("tail", i) for i in range(6)] + [("line", i) for i in range(4)], "doc_id string, node_id int")
    edges = [("ring", i, (i + 1) % 2000) for i in range(2000)] + [("tail", i, i + 1) for i in range(5)] + [("tail", 5, 3)] + [("line", i, i + 1) for i in range(3)] + [("line", 0, 1), ("line", 3, 99), ("line", 98, 0)]
    got = {(r["doc_id"], r["node_id"]): (r["layer"], r["cyclic"]) for r in G.layers(nodes, spark.createDataFrame(edges, "doc_id string, src int, dst int"), checkpoint_every=3).collect()}
    assert len(got) == 2010 and all(v == (None, True) for (d, _), v in got.items() if d != "line")
    assert [got["line", i] for i in range(4)] == [(i, False) for i in range(4)] and len(rounds) <= 7


def test_overlaps_once_each(spark):
    """Random ranges against all pairs, with ranges over many bins, empty ones and null ends."""
    dice = random.Random(6)
    side = lambda n: [(dice.choice("ab"), low := dice.randrange(0, 900), low + dice.choice([0, 1, 3, 40, 700])) for _ in range(n)] + [("a", 0, 1600), (None, 1, 5), ("a", None, 4), ("b", 5, None)]
    left, right = [(k, *r) for k, r in enumerate(side(70))], [(k, *r) for k, r in enumerate(side(70))]
    a, b = spark.createDataFrame(left, "i int, doc string, lo int, hi int"), spark.createDataFrame(right, "j int, doc string, low int, high int")
    wanted = sorted((i, j) for i, d, x, y in left for j, e, u, v in right if d is not None and d == e and None not in (x, y, u, v) and u < y and v > x)
    joined = I.overlaps(a, b, ["doc"], ("lo", "hi"), ("low", "high"), size=64)
    assert sorted((r["i"], r["j"]) for r in joined.collect()) == wanted and len(wanted) > 300
    assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "Cartesian" not in joined._jdf.queryExecution().toString()


def test_spans_that_own_a_hit(spark):
    hits = spark.createDataFrame([(1, "x", 10, 12), (1, "x", 10, 12), (1, "y", 95, 105), (1, "x", 400, 402), (2, "x", 10, 12)], "doc_id int, term string, char_start int, char_end int")
    spans = spark.createDataFrame([(1, "n2", 3, 90, 100), (1, "n1", 2, 0, 5000), (1, "n2", 4, 100, 200), (1, "n1", 1, 12, 20), (1, "n3", 5, 105, 110)], "doc_id int, node_id string, span_id int, span_start int, span_end int")
    got = sorted((r["doc_id"], r["term"], r["char_start"], r["node_ids"], r["span_ids"], r["owned"]) for r in I.owning_spans(hits, spans, ["doc_id"]).collect())
    assert got == [(1, "x", 10, ["n1"], [2], True)] * 2 + [(1, "x", 400, ["n1"], [2], True), (1, "y", 95, ["n1", "n2"], [2, 3, 4], True), (2, "x", 10, [], [], False)]


def _brute_layout(nodes):
    """Rows by running mean height, then edges by row sizes and nearest x."""
    by_page = defaultdict(list)
    for page, node, name, x, y in nodes:
        by_page[page].append((y, x, node, name))
    edges = set()
    for page, rows in by_page.items():
        layers = []
        for y, x, node, name in sorted(rows):
            if not layers or abs(y - sum(r[0] for r in layers[-1]) / len(layers[-1])) > 34.0:
                layers.append([])
            layers[-1].append((y, x, node, name))
        layers = [sorted(layer, key=lambda r: (r[1], r[2])) for layer in layers]
        for up, down in zip(layers, layers[1:]):
            if len(up) == len(down):
                pairs = list(zip(up, down))
            elif len(down) == 1:
                pairs = [(u, down[0]) for u in up]
            elif len(up) == 1:
                pairs = [(up[0], min(down, key=lambda d: abs(d[1] - up[0][1])))]
            elif len({d[3] for d in down}) == 1:
                pairs = [(u, d) for u in up for d in down]
            elif len(up) > len(down):
                pairs = [(u, min(down, key=lambda d: abs(d[1] - u[1]))) for u in up]
            else:
                pairs = [(min(up, key=lambda u: abs(u[1] - d[1])), d) for d in down]
            edges |= {(page, u[2], d[2]) for u, d in pairs if u[2] != d[2]}
    return edges


def test_layout_edges_equal_brute_force(spark):
    rnd = random.Random(11)
    nodes = [(p, p * 100 + i, rnd.choice("xyz"), float(rnd.randint(0, 3000)), float(rnd.randint(0, 40) * 11)) for p in range(12) for i in range(rnd.randint(2, 25))]
    got = G.layout_edges(spark.createDataFrame(nodes, "page int, node_id int, name string, x double, y double"), ["page"])
    assert {(r["page"], r["src"], r["dst"]) for r in got.collect()} == _brute_layout(nodes)


def test_absent_evidence_never_passes(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    checks = spark.createDataFrame([("a", "PASS"), ("a", "HOLD"), ("b", "FAIL"), ("b", "HOLD"), ("b", "PASS")], "doc_id string, status string")
    assert {r["doc_id"]: r["status"] for r in Out.outcome(docs, checks).collect()} == {"a": "HOLD", "b": "FAIL", "c": "HOLD"}


def test_guards_only_lower(spark):
    evaluations = spark.createDataFrame([("d", 1.0, "PASS"), ("d", 2.0, "FAIL"), ("d", 3.0, "HOLD"), ("d", 4.0, "PASS")], "doc_id string, order_idx double, status string")
    checks = spark.createDataFrame([("d", 1.0, "HOLD"), ("d", 2.0, "HOLD"), ("d", 3.0, "FAIL"), ("d", 3.0, "HOLD"), ("d", 4.0, "PASS")], "doc_id string, order_idx double, status string")
    rows = {r["order_idx"]: (r["status"], r["changed"]) for r in Out.apply_guards(evaluations, Out.guards(checks)).collect()}
    assert rows == {1.0: ("HOLD", True), 2.0: ("FAIL", False), 3.0: ("FAIL", True), 4.0: ("PASS", False)}


def test_row_order_and_partitions_do_not_matter(spark):
    rows = [("d%d" % (i % 3), float(i), "test", "무균", "무균시험", f"2024.01.{i % 9 + 1:02d} ~ 2024.02.{i % 20 + 1:02d}") for i in range(60)]
    rule = Rule("r", "duration", {"type": "test", "context": ["무 균"]}, {"minimum_days": 30})
    seen = []
    for parts, data in ((1, rows), (5, rows[::-1])):
        df = spark.createDataFrame(data, "doc_id string, order_idx double, record_type string, section_title string, test_name string, test_period string").repartition(parts)
        seen.append(sorted(map(tuple, R.duration(df, rule).collect())))
    assert seen[0] == seen[1]


def test_conflicting_permits_hold(spark):
    records = spark.createDataFrame([("d", "content", "제조원: 가나")], "doc_id string, record_type string, content string")
    links = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, permit_id int")
    rule = Rule("r", "permit_field", {}, {"sp_field": "제조원", "permit_pattern": r"제조원명 (\S+)"})
    for texts, status in ((["제조원명 가나", "제조원명  가나"], "PASS"), (["제조원명 가나", "제조원명 다라"], "HOLD"), (["", ""], "HOLD"), (["제조원명 다라", ""], "FAIL")):
        pages = spark.createDataFrame([(i + 1, t.replace("  ", " ")) for i, t in enumerate(texts)], "permit_id int, text string")
        assert R.permit_field(records, pages, links, rule).first()["status"] == status


def test_records_of_open_spans(spark):
    """Headings close tests, tables join the innermost span, names alone are no records, contents end with their block."""
    texts = ["앞글", "1.1 제조 기록", "본문", "가 | 나", "무균시험", "기준: 음성", "결과: 음성", "결과: 음성", "a | b", "1 | 2", "설명", "c | d", "엔도톡신", "1.2 다음 장", "뒷글", "결과: 5 mg", "성상", "비고: 없음"]
    rows = [(d, k, x) for d in (1, 2) for k, x in enumerate(texts)] + [(3, k, f"줄 {k}") for k in range(9)]
    lines = spark.createDataFrame(rows, "doc_id int, line_no int, line string").withColumn("block", F.floor(F.col("line_no") / 4))
    typed = L.classify(lines).withColumn("starts", L.is_test_name(F.col("line")))
    got = A.section_records(typed, ["doc_id"], "line_no").collect()
    pick = lambda d, *cols: [tuple(r[c] for c in cols) for r in sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["order_idx"])]
    assert pick(1, "order_idx", "record_type", "section_number", "test_name", "criteria", "result", "narrative", "tables", "content", "part") == [
        (0, "content", None, None, None, None, None, 0, "앞글", 0), (1, "content", "1.1", None, None, None, None, 0, "본문\n가 | 나", 0),
        (2, "test", "1.1", "무균시험", "음성", "음성\na | b\n1 | 2\nc | d", "설명", 2, None, 0),
        (3, "content", "1.2", None, None, None, None, 0, "뒷글\n결과: 5 mg", 0), (4, "test", "1.2", "성상", None, None, None, 0, None, 0)]
    assert pick(2, "record_type", "content") == pick(1, "record_type", "content")
    assert pick(3, "part", "content") == [(0, "줄 0\n줄 1\n줄 2\n줄 3"), (1, "줄 4\n줄 5\n줄 6\n줄 7"), (2, "줄 8")]
    assert A.section_records(typed.limit(0), ["doc_id"], "line_no").count() == 0


def test_paths_of_any_depth(spark):
    heads = ["1 장", "1.1 절", "1.1.1 항", "1.1.1.1 목", "1.1.1.1.1 세목", "1.2 절"]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(heads)], "doc_id int, line_no int, line string").withColumn("block", F.floor(F.col("line_no") / 4))
    paths = L.section_paths(L.classify(lines), ["doc_id"], "line_no")
    got = {r["line_no"]: [p["pos"] for p in r["path"]] for r in paths.collect()}
    assert got[4] == [0, 1, 2, 3, 4] and got[3] == [0, 1, 2, 3] and got[5] == [0, 5]


def test_all_stages_of_a_row(spark):
    """Two stages of one lot are both kept; a longer stage text finds its stage; the same text goes before it; null keys meet nothing."""
    form = "doc_id int, {} string, lot string, made string, amount string"
    items = spark.createDataFrame([(1, "bulk", "L1", None, None), (1, "fill", "L1", "d", "5"), (1, "bulk process", "L2", "d", None), (2, "bulk", "L9", None, None), (1, None, "L3", None, "")], form.format("stage_key"))
    body = spark.createDataFrame([(1, 1, "other", "L1", "d", None), (1, 2, "the fill step", "L2", None, None), (1, 3, "bulk process", "L1", None, None), (1, 4, None, "L7", "d", "5"), (1, 5, "", None, None, "5"), (2, 6, "bul", None, None, None)],
                                 form.format("x").replace("x string", "row_id int, stage_key string"))
    got = sorted(tuple(r) for r in M.stage_occurrences(items, body).collect())
    assert got == [(1, 1, "bulk", 2), (1, 1, "fill", 2), (1, 2, "fill", 1), (1, 3, "bulk process", 1), (1, 4, "bulk process", 3), (1, 4, "fill", 3), (1, 5, "fill", 4), (2, 6, "bulk", 1)]


def test_parts_of_runs(spark):
    """Order and null places count as the multiset says; repeats and missing parts differ."""
    schema = "doc_id long, part string, name string, value string"
    left = [(1, "tests", "a", None), (1, "tests", "b", "x"), (1, "summary", "n", "2"), (2, "tests", None, "a"), (3, "tests", "a", "x"), (3, "tests", "a", "x")]
    right = [(1, "tests", "b", "x"), (1, "tests", "a", None), (2, "tests", "a", None), (3, "tests", "a", "x"), (4, "tests", "a", "x")]
    got = Rep.part_equality(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "doc_id", "part")
    assert sorted(map(tuple, got.collect())) == [
        (1, "summary", False, False, 1), (1, "tests", True, True, 0), (2, "tests", True, False, 2), (3, "tests", True, False, 1), (4, "tests", False, False, 1)]
    assert Rep.part_equality(spark.createDataFrame([], schema), spark.createDataFrame([], schema), "doc_id", "part").collect() == []


def test_search_deals_documents_to_blocks(spark):
    """Small blocks give the same ranking as large ones."""
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    corpus = [(i, None if i == 7 else " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 40)))) for i in range(300)]
    questions = [(i, " ".join(rnd.choices(vocabulary, k=6))) for i in range(5)]
    docs, asked = spark.createDataFrame(corpus, "doc long, text string"), spark.createDataFrame(questions, "query long, text string")
    few, many = (sorted((r["query"], r["rank"], r["doc"], round(r["score"], 9)) for r in K.search(docs, asked, k=4, block_bytes=size).collect()) for size in (1 << 30, 4096))
    assert few == many and len(few) == 20


def test_run_equality_counts_both_runs_without_a_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b"), (3, "c")], "k long, v string")
    right = spark.createDataFrame([(1, "a"), (1, None), (1, None), (2, "b"), (4, "c")], "k long, v string")
    got = Rep.run_equality(left, right, "k")
    assert sorted(map(tuple, got.collect())) == [(1, True, False, 2), (2, True, True, 0), (3, False, False, 1), (4, False, False, 1)]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_line_is_cleaned_once(spark):
    """No condition on the cleaned line makes the clean-up anew, and odd line ends stay as they were."""
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(["  a  .....", "..", "-- ..", "....\u0085", "x _____ y _____", "메모 포함 [/최3R1] : x", None, "b --- "])], "line_no int, raw string")
    kept = L.clean_lines(rows)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert {r["line_no"]: r["line"] for r in kept.collect()} == {0: "a", 4: "x _____ y", 7: "b ---"}


@pytest.mark.parametrize("items_most, rows_most", [(64, 1 << 16), (2, 1 << 16), (64, 2), (0, 0)])
def test_stages_of_large_and_small_documents_agree(spark, monkeypatch, items_most, rows_most):
    """Documents whose rows meet all items and documents joined by each reason give the stages of a plain loop."""
    monkeypatch.setattr(M, "MANY_NAMES", items_most)
    monkeypatch.setattr(O, "WHOLE_ROWS", rows_most)
    rnd = random.Random(5)
    pick = lambda *values: rnd.choice([None, "", *values])
    items = [(rnd.choice([1, 2, 3, None]), pick("fill", "bulk", "bulk process"), pick("L1", "L2"), pick("d"), pick("q")) for _ in range(14)]
    body = [(rnd.choice([1, 2, 3, None]), k, pick("fill", "bulk", "process", "x"), pick("L1", "L2"), pick("d", "e"), pick("q")) for k in range(30)]
    want = set()
    for d, k, written, *values in body:
        found = set()
        for e, stage, *known in items:
            if d is None or d != e:
                continue
            if stage and written and (stage in written or written in stage):
                found.add((1, stage != written, stage))
            found |= {(r, False, stage) for r, (v, w) in enumerate(zip(values, known), 2) if v and v == w}
        best = min((f[:2] for f in found), default=None)
        want |= {(d, k, stage, rank) for rank, loose, stage in found if (rank, loose) == best}
    columns = "stage_key string, lot string, made string, amount string"
    got = M.stage_occurrences(spark.createDataFrame(items, "doc_id int, " + columns), spark.createDataFrame(body, "doc_id int, row_id int, " + columns)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 10


def test_rows_of_small_documents_meet_their_items_in_one_join(spark):
    rows = spark.range(100).selectExpr("id % 40 as doc_id", "id as row_id", "'s' as stage_key", "concat('L', id % 3) as lot", "string(null) as made", "string(null) as amount")
    plan = M.stage_occurrences(rows.drop("row_id"), rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Exchange") == 2 and "Broadcast" not in plan


def test_parts_of_runs_are_counted_without_a_join(spark):
    run = spark.range(20).selectExpr("id % 5 as doc_id", "'tests' as part", "string(id) as name", "string(id) as value")
    assert "Join" not in Rep.part_equality(run, run, "doc_id", "part")._jdf.queryExecution().optimizedPlan().toString()
