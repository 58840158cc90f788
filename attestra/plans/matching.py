"""Retrieval, profiles, graphs and manufacturing cross-checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import manufacturing as M
from ..operators import retrieval as K
from .registry import query
from .ruling import SHIFT, dotted, lines

_WORDS_SQL = """
src AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
w AS (SELECT side, id, REGEXP_EXTRACT_ALL(text, '[\\p{L}\\p{M}\\p{N}_\\[\\]/.%''*-]+') AS ws FROM src),
t AS (SELECT side, id, UNNEST(LIST_CONCAT(ws, LIST_TRANSFORM(RANGE(1, LEN(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
"""
_CHARS_SQL = """
src AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
w AS (SELECT side, id, UNNEST(LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(text, '\\s+'), lambda x: x <> '')) AS word FROM src),
d AS (SELECT side, id, ' ' || word || ' ' AS p, COUNT(*) AS times FROM w GROUP BY ALL),
g AS (SELECT side, id, times, UNNEST(LIST_CONCAT(
  LIST_TRANSFORM(RANGE(1, GREATEST(LENGTH(p) - 2 + 2, 2)), lambda i: SUBSTR(p, i, 2)),
  CASE WHEN LENGTH(p) > 2 THEN LIST_TRANSFORM(RANGE(1, GREATEST(LENGTH(p) - 3 + 2, 2)), lambda i: SUBSTR(p, i, 3)) ELSE [] END,
  CASE WHEN LENGTH(p) > 3 THEN LIST_TRANSFORM(RANGE(1, GREATEST(LENGTH(p) - 4 + 2, 2)), lambda i: SUBSTR(p, i, 4)) ELSE [] END,
  CASE WHEN LENGTH(p) > 4 THEN LIST_TRANSFORM(RANGE(1, GREATEST(LENGTH(p) - 5 + 2, 2)), lambda i: SUBSTR(p, i, 5)) ELSE [] END)) AS term FROM d),
"""


def _vectors(prefix: str, counted: str) -> str:
    return f"""{prefix}tf AS ({counted}),
{prefix}idf AS (SELECT term, LN((1.0 + (SELECT COUNT(*) FROM documents)) / (COUNT(*) + 1)) + 1 AS idf FROM {prefix}tf WHERE side = 'd' GROUP BY term),
{prefix}raw AS (SELECT side, id, term, tf * idf AS w FROM {prefix}tf JOIN {prefix}idf USING (term)),
{prefix}norm AS (SELECT side, id, SQRT(SUM(w * w)) AS norm FROM {prefix}raw GROUP BY ALL),
{prefix}dot AS (SELECT q.id AS query, d.id AS doc, SUM(q.w * d.w) / (ANY_VALUE(nq.norm) * ANY_VALUE(nd.norm)) AS score
  FROM {prefix}raw q JOIN {prefix}raw d ON q.term = d.term AND q.side = 'q' AND d.side = 'd'
  JOIN {prefix}norm nq ON nq.side = 'q' AND nq.id = q.id JOIN {prefix}norm nd ON nd.side = 'd' AND nd.id = d.id GROUP BY ALL)"""


_WORD_PART = _WORDS_SQL + _vectors("w", "SELECT side, id, term, COUNT(*) AS tf FROM t GROUP BY ALL")
_CHAR_PART = _CHARS_SQL + _vectors("c", "SELECT side, id, term, SUM(times) AS tf FROM g GROUP BY ALL")
_RANK = "ROW_NUMBER() OVER (PARTITION BY query ORDER BY ROUND(score, 9) DESC, doc)"


def _corpus(t):
    docs = t.wide("documents", F.col("doc_id").alias("doc"), "text")
    return docs, t.benchmark.select(F.col("item_id").alias("query"), "text")


@query("tfidf_words", "K1 K2 T20", f"""WITH {_WORD_PART}
SELECT query, doc, ROUND(score, 6) AS score, rank FROM (SELECT *, {_RANK} AS rank FROM wdot) WHERE rank <= 5""")
def tfidf_words(t):
    found = K.search(*_corpus(t), k=5, chars=False)
    return found.select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query("tfidf_chars", "K1 K2", f"""WITH {_CHAR_PART}
SELECT query, doc, ROUND(score, 6) AS score, rank FROM (SELECT *, {_RANK} AS rank FROM cdot) WHERE rank <= 5""")
def tfidf_chars(t):
    found = K.search(*_corpus(t), k=5, words=False)
    return found.select("query", "doc", F.round("score", 6).alias("score"), "rank")


_FUSED = f"""{_WORD_PART}, {_CHAR_PART.replace('src AS', 'src2 AS', 1).replace('FROM src)', 'FROM src2)', 1).replace('w AS (SELECT side, id, UNNEST', 'cw AS (SELECT side, id, UNNEST', 1).replace('FROM w GROUP', 'FROM cw GROUP', 1)},
dot AS (SELECT query, doc, SUM(score) AS score FROM (SELECT query, doc, 0.65 * score AS score FROM wdot UNION ALL SELECT query, doc, 0.35 * score FROM cdot) GROUP BY ALL),
ranked AS (SELECT *, {_RANK} AS rank FROM dot)"""


@query("diverse_context", "K3", f"""WITH {_FUSED},
top AS (SELECT r.query, r.doc, source AS domain, r.rank FROM ranked r JOIN documents ON doc_id = r.doc WHERE r.rank <= 12),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query, domain ORDER BY rank) = 1 AS first FROM top),
h AS (SELECT *, first AND ROW_NUMBER() OVER (PARTITION BY query, first ORDER BY rank) <= 4 AS head FROM f),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY head DESC, rank) AS place FROM h)
SELECT query, doc, domain, place FROM p WHERE place <= 6""")
def diverse_context(t):
    docs, questions = _corpus(t)
    ranked = K.search(docs, questions, k=12).join(t.documents.select(F.col("doc_id").alias("doc"), F.col("source").alias("domain")), "doc")
    return K.diverse(ranked, k=6)


@query("context_budget", "K5", """
WITH m AS (SELECT c_nationkey AS query, c_custkey % 7 AS place, MIN(c_name) AS name FROM customer GROUP BY ALL),
c AS (SELECT query, place, name || REPEAT('x', CAST(query AS BIGINT)) AS text FROM m),
u AS (SELECT *, 120 - COALESCE(SUM(LENGTH(text) + 2) OVER (PARTITION BY query ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM c)
SELECT query, STRING_AGG(SUBSTR(text, 1, CAST(room AS BIGINT)), CHR(10) || CHR(10) ORDER BY place) AS context FROM u WHERE room > 0 GROUP BY query""")
def context_budget(t):
    rows = t.customer.groupBy(F.col("c_nationkey").alias("query"), (F.col("c_custkey") % 7).alias("place")).agg(F.min("c_name").alias("text"))
    return K.context_text(rows.withColumn("text", F.concat("text", F.repeat(F.lit("x"), F.col("query")))), 120)


@query("profile_match", "K4 U3", """
WITH q AS (SELECT c_custkey AS query, CASE c_custkey % 4 WHEN 0 THEN 'nation_' || c_nationkey WHEN 1 THEN 'thelineofnation_' || c_nationkey WHEN 2 THEN 'tion_' ELSE 'zz' END AS q FROM customer),
a AS (SELECT CASE WHEN n_regionkey = 0 THEN 'company' ELSE 'product' END AS scope, 'P' || LPAD(CAST(n_nationkey AS VARCHAR), 2, '0') AS profile, LOWER(n_name) AS a, n_regionkey AS priority FROM nation),
s AS (SELECT query, scope, profile, priority, priority + CASE WHEN q = a THEN 100000 + LENGTH(a) WHEN CONTAINS(q, a) THEN 50000 + LENGTH(a) WHEN CONTAINS(a, q) THEN 10000 + LENGTH(q) END AS score FROM q, a)
SELECT query, scope, profile, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query, scope ORDER BY score DESC, priority DESC, profile DESC) AS n FROM s WHERE score IS NOT NULL) WHERE n = 1""")
def profile_match(t):
    k = F.col("c_custkey") % 4
    text = (F.when(k == 0, F.concat(F.lit("Nation_"), "c_nationkey")).when(k == 1, F.concat(F.lit("The line of NATION_ "), "c_nationkey"))
            .when(k == 2, "tion_").otherwise("zz"))
    questions = t.wide("customer", F.col("c_custkey").alias("query"), text.alias("text"))
    aliases = t.nation.select(F.when(F.col("n_regionkey") == 0, "company").otherwise("product").alias("scope"),
                              F.concat(F.lit("P"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("profile"), F.col("n_name").alias("alias"), F.col("n_regionkey").alias("priority"))
    return K.best_profiles(questions, aliases).withColumn("score", F.col("score").cast("bigint"))


# ---- graphs: parts as nodes, edges i -> 2i and i -> 3i, one diagram per range of 400 parts

_GRAPH_SQL = """n AS (SELECT p_partkey // 400 AS doc_id, p_partkey % 400 + 1 AS node FROM part),
e AS (SELECT DISTINCT a.doc_id, a.node AS src, b.node AS dst FROM n a JOIN n b ON a.doc_id = b.doc_id AND (b.node = 2 * a.node OR b.node = 3 * a.node))"""


def part_graph(t):
    nodes = t.part.select(F.floor(F.col("p_partkey") / 400).alias("doc_id"), (F.col("p_partkey") % 400 + 1).alias("node_id"), "p_name")
    ids = nodes.select("doc_id", "node_id")
    steps = ids.select("doc_id", F.col("node_id").alias("src"), F.explode(F.array(F.col("node_id") * 2, F.col("node_id") * 3)).alias("dst"))
    edges = steps.join(ids.withColumnRenamed("node_id", "dst"), ["doc_id", "dst"]).select("doc_id", "src", "dst").distinct()
    return nodes, edges


@query("graph_layers", "D5", f"""WITH RECURSIVE {_GRAPH_SQL},
w AS (SELECT doc_id, node, 0 AS layer FROM n UNION SELECT e.doc_id, e.dst, layer + 1 FROM w JOIN e ON e.doc_id = w.doc_id AND e.src = w.node)
SELECT doc_id, node AS node_id, MAX(layer) AS layer, FALSE AS cyclic FROM w GROUP BY ALL""")
def graph_layers(t):
    return G.layers(*part_graph(t))


@query("graph_cycles", "D5", f"""WITH RECURSIVE {_GRAPH_SQL},
b AS (SELECT doc_id, src, dst FROM e UNION ALL SELECT doc_id, node, 1 FROM n WHERE doc_id % 3 = 1 AND node % 6 = 0),
w AS (SELECT doc_id, node, 0 AS layer FROM n UNION SELECT e.doc_id, e.dst, layer + 1 FROM w JOIN e ON e.doc_id = w.doc_id AND e.src = w.node),
r AS (SELECT doc_id, src, dst FROM b UNION SELECT r.doc_id, r.src, b.dst FROM r JOIN b ON b.doc_id = r.doc_id AND b.src = r.dst),
k AS (SELECT DISTINCT doc_id FROM r WHERE src = dst)
SELECT w.doc_id, node AS node_id, CASE WHEN k.doc_id IS NULL THEN MAX(layer) END AS layer, k.doc_id IS NOT NULL AS cyclic FROM w LEFT JOIN k ON k.doc_id = w.doc_id GROUP BY w.doc_id, node, k.doc_id""")
def graph_cycles(t):
    """In every third diagram steps lead back to the first one: no layers there, the others keep theirs."""
    nodes, edges = part_graph(t)
    back = nodes.where("doc_id % 3 = 1 and node_id % 6 = 0").select("doc_id", F.col("node_id").alias("src"), F.lit(1).cast("bigint").alias("dst"))
    return G.layers(nodes, edges.unionByName(back))


@query("graph_lanes", "D6", f"""WITH RECURSIVE {_GRAPH_SQL},
w AS (SELECT doc_id, node, 0 AS layer FROM n UNION SELECT e.doc_id, e.dst, layer + 1 FROM w JOIN e ON e.doc_id = w.doc_id AND e.src = w.node),
l AS (SELECT doc_id, node, node % 11 = 0 AS extra, MAX(layer) AS layer FROM w GROUP BY ALL),
p AS (SELECT *, CASE WHEN extra THEN MAX(CASE WHEN NOT extra THEN layer END) OVER (PARTITION BY doc_id) ELSE layer END AS final_layer FROM l)
SELECT doc_id, node AS node_id, final_layer AS layer, ROW_NUMBER() OVER (PARTITION BY doc_id, final_layer ORDER BY extra, node) - 1 AS lane FROM p""")
def graph_lanes(t):
    layered = G.layers(*part_graph(t))
    kinds = layered.select("doc_id", "node_id", "layer", F.col("node_id").alias("position"), F.when(F.col("node_id") % 11 == 0, "check").otherwise("process").alias("kind"))
    return G.lanes(kinds).select("doc_id", "node_id", "layer", "lane")


@query("graph_checks", "D4", f"""WITH {_GRAPH_SQL}, nn AS (SELECT p_partkey // 400 AS doc_id, CASE WHEN p_partkey % 97 = 5 THEN p_partkey % 400 ELSE p_partkey % 400 + 1 END AS node, p_name, p_partkey % 400 = 7 AND p_partkey > 900 AS second FROM part),
ee AS (SELECT * FROM e UNION ALL SELECT doc_id, src, dst FROM e WHERE src % 50 = 0),
x AS (SELECT doc_id, src AS node FROM ee UNION ALL SELECT doc_id, dst FROM ee)
SELECT d.doc_id, d.several_diagrams, (SELECT COUNT(*) FROM (SELECT node FROM nn WHERE nn.doc_id = d.doc_id GROUP BY node HAVING COUNT(*) > 1)) AS repeated_ids,
  (SELECT COUNT(*) FROM (SELECT p_name FROM nn WHERE nn.doc_id = d.doc_id GROUP BY p_name HAVING COUNT(*) > 1)) AS repeated_names,
  (SELECT COUNT(*) FROM x WHERE x.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM nn WHERE nn.doc_id = d.doc_id AND nn.node = x.node)) AS dangling,
  (SELECT COUNT(*) FROM (SELECT src, dst FROM ee WHERE ee.doc_id = d.doc_id GROUP BY ALL HAVING COUNT(*) > 1)) AS repeated_edges
FROM (SELECT doc_id, BOOL_OR(second) AND NOT BOOL_AND(second) AS several_diagrams FROM nn GROUP BY doc_id) d""")
def graph_checks(t):
    _, edges = part_graph(t)
    p = F.col("p_partkey")
    nodes = t.part.select(F.floor(p / 400).alias("doc_id"), F.when(p % 97 == 5, p % 400).otherwise(p % 400 + 1).alias("node_id"), F.col("p_name").alias("name"),
                          F.when((p % 400 == 7) & (p > 900), 2).otherwise(1).alias("diagram"))
    return G.graph_errors(nodes, edges.unionByName(edges.where("src % 50 = 0")))


@query("chain_edges", "D2", """
WITH n AS (SELECT c_nationkey AS doc_id, c_custkey AS position, CASE WHEN c_custkey > 800 THEN 'Merged' ELSE c_mktsegment END AS component FROM customer),
c AS (SELECT doc_id, LAG(position) OVER (PARTITION BY doc_id, component ORDER BY position) AS src, position AS dst FROM n),
j AS (SELECT doc_id, MIN(position) AS m FROM n WHERE component = 'Merged' GROUP BY doc_id),
f AS (SELECT n.doc_id, MAX(position) AS src, m AS dst FROM n JOIN j USING (doc_id) WHERE component <> 'Merged' AND position < m GROUP BY n.doc_id, component, m)
SELECT * FROM c WHERE src IS NOT NULL UNION ALL SELECT doc_id, src, dst FROM f""")
def chain_edges(t):
    component = F.when(F.col("c_custkey") > 800, "Merged").otherwise(F.col("c_mktsegment"))
    return G.chain_edges(t.customer.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("position"), F.col("c_custkey").alias("node_id"), component.alias("component")))


_PHASE_SQL = """n AS (SELECT c_custkey // 12 AS doc_id, c_custkey AS node, CASE WHEN c_custkey % 12 < 11 THEN (c_custkey // 3 + c_nationkey) % 3 END AS raw,
  CASE c_nationkey % 4 WHEN 0 THEN 'cho' WHEN 1 THEN 'ecoli' END AS prefix FROM customer),
p AS (SELECT doc_id, node, prefix, COALESCE(raw, MAX(raw) OVER (PARTITION BY doc_id)) AS phase FROM n),
s AS (SELECT doc_id, phase, LEAD(phase) OVER (PARTITION BY doc_id ORDER BY phase) AS nxt FROM (SELECT DISTINCT doc_id, phase FROM p)),
a AS (SELECT p.doc_id, p.phase, nxt, node, prefix FROM p JOIN s ON p.doc_id = s.doc_id AND p.phase = s.phase WHERE nxt IS NOT NULL),
same AS (SELECT a.doc_id, a.phase, a.node AS src, b.node AS dst FROM a JOIN p b ON a.doc_id = b.doc_id AND b.phase = a.nxt AND a.prefix = b.prefix),
fs AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, phase ORDER BY node) AS i, COUNT(*) OVER (PARTITION BY doc_id, phase) AS ns FROM a
  WHERE NOT EXISTS (SELECT 1 FROM same WHERE same.doc_id = a.doc_id AND same.src = a.node)),
alld AS (SELECT s.doc_id, s.phase, p.node FROM s JOIN p ON p.doc_id = s.doc_id AND p.phase = s.nxt),
fd AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, phase ORDER BY node) AS i, COUNT(*) OVER (PARTITION BY doc_id, phase) AS nd FROM alld
  WHERE NOT EXISTS (SELECT 1 FROM same WHERE same.doc_id = alld.doc_id AND same.dst = alld.node)),
c AS (SELECT DISTINCT fs.doc_id, fs.phase, ns, COALESCE(nd, 0) AS nd FROM fs LEFT JOIN fd ON fs.doc_id = fd.doc_id AND fs.phase = fd.phase)"""


@query("phase_edges", "D3", f"""WITH {_PHASE_SQL}
SELECT doc_id, src, dst FROM same
UNION ALL SELECT fs.doc_id, fs.node, fd.node FROM fs JOIN fd ON fs.doc_id = fd.doc_id AND fs.phase = fd.phase AND fs.i = fd.i AND fs.ns = fd.nd
UNION ALL SELECT fs.doc_id, fs.node, fd.node FROM fs JOIN fd ON fs.doc_id = fd.doc_id AND fs.phase = fd.phase AND fs.ns <> fd.nd
UNION ALL SELECT fs.doc_id, fs.node, alld.node FROM fs JOIN c ON fs.doc_id = c.doc_id AND fs.phase = c.phase AND c.nd = 0 JOIN alld ON alld.doc_id = fs.doc_id AND alld.phase = fs.phase""")
def phase_edges(t):
    c = F.col("c_custkey")
    nodes = t.customer.select(F.floor(c / 12).alias("doc_id"), c.alias("node_id"), c.alias("position"),
                              F.when(c % 12 < 11, (F.floor(c / 3) + F.col("c_nationkey")) % 3).alias("phase"),
                              F.when(F.col("c_nationkey") % 4 == 0, "cho").when(F.col("c_nationkey") % 4 == 1, "ecoli").alias("prefix"))
    return G.phase_edges(nodes)


@query("layout_edges", "D1")
def layout_edges(t):
    nodes = t.part.select(F.floor(F.col("p_partkey") / 20).alias("doc_id"), F.col("p_partkey").alias("node_id"), F.col("p_type").alias("name"),
                          (F.col("p_partkey") * 37 % 500).cast("double").alias("x"), (F.col("p_size") * 9.0).alias("y"))
    return G.layout_edges(nodes, ["doc_id"])


@query("graph_choice", "D7", """
SELECT l_orderkey AS doc_id, CASE WHEN BOOL_AND(EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey % 6 < 4 AND b.l_suppkey % 6 = a.l_linenumber % 4)) THEN 'extracted' ELSE 'inferred' END AS graph
FROM lineitem a GROUP BY l_orderkey""")
def graph_choice(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("Stage "), F.col("l_linenumber") % 4).alias("exported"), F.concat(F.lit("stage"), F.col("l_suppkey") % 6).alias("extracted"))
    return G.choose_graph(rows.select("doc_id", F.col("extracted").alias("name")), rows.select("doc_id", F.col("exported").alias("name")))


@query("graph_counts", "D8", """
WITH n AS (SELECT l_orderkey AS doc_id, l_linenumber AS k, COUNT(*) AS same, MIN(l_suppkey) AS node FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS doc_id, 'STAGE ' || f AS name, CASE WHEN same = 1 THEN node END AS node_id, o_custkey AS total,
  CASE WHEN same IS NULL THEN 'unknown_name' WHEN same > 1 THEN 'ambiguous_name' END AS problem
FROM orders, (VALUES (1), (2)) v(f) LEFT JOIN n ON n.doc_id = o_orderkey AND n.k = f""")
def graph_counts(t):
    nodes = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("node_id"), F.concat(F.lit("Stage"), "l_linenumber").alias("name"))
    counts = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit("STAGE 1"), F.lit("STAGE 2"))).alias("name"), F.col("o_custkey").alias("total"))
    return G.attach_counts(nodes, counts)


@query("diagram_nodes", "D9", """
SELECT o_custkey AS doc_id, o_orderkey AS name, CASE WHEN o_orderkey % 3 <> 0 THEN 'L' || o_orderkey END AS lot, (o_orderkey % 90) || ' L' AS amount FROM orders""")
def diagram_nodes(t):
    o = F.col("o_orderkey")
    rows = F.array_compact(F.array(
        F.struct(F.lit(0).alias("k"), F.lit("공정명").alias("label"), o.cast("string").alias("value")),
        F.when(o % 3 != 0, F.struct(F.lit(1).alias("k"), F.lit("제조번호").alias("label"), F.concat(F.lit("L"), o).alias("value"))),
        F.struct(F.lit(2).alias("k"), F.lit("기타").alias("label"), F.lit("x").alias("value")),
        F.struct(F.lit(3).alias("k"), F.lit("제조량").alias("label"), F.concat(o % 90, F.lit(" L")).alias("value"))))
    cells = t.wide("orders", o, F.col("o_custkey")).select(F.col("o_custkey").alias("doc_id"), F.explode(rows).alias("r"), o).select(
        "doc_id", (F.col("o_orderkey") * 4 + F.col("r.k")).alias("position"), "r.label", "r.value")
    nodes = G.nodes_from_cells(cells, ["제조번호", "제조량"], "공정명")
    return nodes.select("doc_id", F.col("name").cast("bigint").alias("name"), F.try_element_at("fields", F.lit("제조번호")).alias("lot"), F.try_element_at("fields", F.lit("제조량")).alias("amount"))


# ---- manufacturing

@query("lot_windows", "M1", """
SELECT o_custkey AS doc_id, 'L-' || o_orderkey AS lot, v.field, CASE v.i WHEN 1 THEN '2024.0' || (o_orderkey % 9 + 1) || '.01' ELSE (o_orderkey % 70) || ' vial' END AS value
FROM orders, (VALUES (1, '제조년월일'), (2, '제조량')) v(i, field) WHERE NOT (v.i = 2 AND o_orderkey % 2 = 0)""")
def lot_windows(t):
    o = F.col("o_orderkey")
    # in even orders the quantity is written too far below the lot to belong to it
    rows = F.array(F.struct(F.lit(0).alias("k"), F.concat(F.lit("제조번호: L-"), o).alias("text")),
                   F.struct(F.lit(2).alias("k"), F.concat(F.lit("제조 년월일 2024.0"), o % 9 + 1, F.lit(".01")).alias("text")),
                   F.struct(F.when(o % 2 == 0, 20).otherwise(5).alias("k"), F.concat(F.lit("제조량 | "), o % 70, F.lit(" vial")).alias("text")))
    lines_ = t.wide("orders", o, F.col("o_custkey")).select(F.col("o_custkey").alias("doc_id"), F.explode(rows).alias("r"), o).select(
        "doc_id", (F.col("o_orderkey") * 32 + F.col("r.k")).alias("position"), "r.text")
    return M.lot_windows(lines_, "제조번호", ["제조년월일", "제조량"]).select("doc_id", "lot", "field", "value")


@query("lot_agreement", "M2 M3 R25 N11 N12", """
WITH o AS (SELECT l_orderkey AS doc_id, l_suppkey % 10 AS lot, 'made' AS f, CAST(l_linenumber % 3 AS VARCHAR) AS v FROM lineitem
  UNION ALL SELECT l_orderkey, l_suppkey % 10, 'amount', CAST(l_linenumber % 2 AS VARCHAR) FROM lineitem)
SELECT doc_id, 'LOT' || lot AS lot, CASE f WHEN 'made' THEN '제조년월일' ELSE '제조량' END AS field, COUNT(*) AS n, CASE WHEN MIN(v) = MAX(v) THEN 'PASS' ELSE 'FAIL' END AS status
FROM o GROUP BY doc_id, lot, f HAVING COUNT(*) >= 2""")
def lot_agreement(t):
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    lot = F.when(n % 2 == 0, F.concat(F.lit("lot-"), s % 10)).otherwise(F.concat(F.lit("LOT "), s % 10))
    made = F.when(s % 2 == 0, F.concat(F.lit("2024.03.0"), n % 3 + 1)).otherwise(F.concat(F.lit("2024년 3월 "), n % 3 + 1, F.lit("일")))
    amount = F.when(s % 2 == 0, F.concat(F.lit("1,50"), n % 2, F.lit(" 바이알"))).otherwise(F.concat(F.lit("150"), n % 2, F.lit(".0 EA")))
    rows = t.wide("lineitem", F.col("l_orderkey").alias("doc_id"), lot.alias("lot"), F.explode(F.array(
        F.struct(F.lit("제조년월일").alias("field"), made.alias("value")), F.struct(F.lit("제조량").alias("field"), amount.alias("value")))).alias("v"))
    return M.lot_agreement(rows.select("doc_id", "lot", "v.field", "v.value"))


@query("field_compare", "M3", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_suppkey % 3 = l_partkey % 3 THEN 'PASS' ELSE 'FAIL' END
  WHEN 1 THEN CASE WHEN l_suppkey % 3 = l_partkey % 3 OR l_suppkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END
  WHEN 2 THEN CASE WHEN l_suppkey % 3 = l_partkey % 3 THEN 'PASS' ELSE 'FAIL' END ELSE 'FAIL' END AS status FROM lineitem""")
def field_compare(t):
    k, a, b = F.col("l_linenumber") % 4, F.col("l_suppkey") % 3 + 1, F.col("l_partkey") % 3 + 1
    field = F.when(k == 0, "제조번호").when(k == 1, "제조년월일").otherwise("제조량")
    left = F.when(k == 0, F.concat(F.lit("26ab-"), a)).when(k == 1, F.concat(F.lit("2024.05"), F.when(F.col("l_suppkey") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(".0"), a)))).when(k == 2, F.concat(a, F.lit(".50 ㎖"))).otherwise("")
    right = F.when(k == 0, F.concat(F.lit("26AB "), b)).when(k == 1, F.concat(F.lit("2024-5-"), b)).when(k == 2, F.concat(b, F.lit(".5 mL"))).otherwise("5 L")
    rows = t.wide("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.withColumn("status", M.compare_field(field, left, right))


@query("summary_items", "M8", """
SELECT o_custkey AS doc_id, 'stage' || (o_orderkey % 5) AS stage_key, ARG_MIN('L' || o_orderkey, o_orderkey) AS lot, MIN(o_orderkey) AS position FROM orders GROUP BY ALL""")
def summary_items(t):
    o = F.col("o_orderkey")
    label = F.get(F.array(F.lit("제조번호"), F.lit("로트번호"), F.lit("배치번호")), (o % 3).cast("int"))
    nodes = t.wide("orders", F.col("o_custkey").alias("doc_id"), o.alias("position"), F.concat(F.lit("Stage "), o % 5).alias("name"), F.create_map(label, F.concat(F.lit("L"), o)).alias("fields"))
    return M.summary_items(nodes).select("doc_id", "stage_key", "lot", "position")


@query("stage_occurrences", "M4", """
WITH i AS (SELECT DISTINCT l_orderkey AS doc_id, 's' || (l_suppkey % 5) AS stage, 'L' || (l_partkey % 7) AS lot FROM lineitem),
b AS (SELECT l_orderkey AS doc_id, l_linenumber AS row_id, 's' || (l_linenumber + 2) || CASE WHEN l_linenumber % 2 = 0 THEN ' process' ELSE '' END AS sk, 'L' || l_linenumber AS lot FROM lineitem GROUP BY ALL),
m AS (SELECT DISTINCT b.doc_id, row_id, stage, 1 AS rank FROM b JOIN i ON i.doc_id = b.doc_id AND CONTAINS(sk, i.stage)
  UNION ALL SELECT b.doc_id, row_id, stage, 2 FROM b JOIN i ON i.doc_id = b.doc_id AND i.lot = b.lot)
SELECT DISTINCT doc_id, row_id, stage, rank FROM (SELECT *, MIN(rank) OVER (PARTITION BY doc_id, row_id) AS best FROM m) WHERE rank = best""")
def stage_occurrences(t):
    base = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_suppkey", "l_partkey")
    none = F.lit(None).cast("string")
    items = base.select("doc_id", F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("stage_key"), F.concat(F.lit("L"), F.col("l_partkey") % 7).alias("lot"), none.alias("made"), none.alias("amount"))
    body = base.select("doc_id", F.col("l_linenumber").alias("row_id"), F.concat(F.lit("s"), F.col("l_linenumber") + 2, F.when(F.col("l_linenumber") % 2 == 0, " process").otherwise("")).alias("stage_key"), F.concat(F.lit("L"), "l_linenumber").alias("lot"), none.alias("made"), none.alias("amount")).distinct()
    return M.stage_occurrences(items, body)


_NODES_SQL = f"""i AS (SELECT l_orderkey AS doc_id, l_linenumber AS node, MIN(CAST(l_shipdate AS DATE) + {SHIFT}) AS made FROM lineitem GROUP BY ALL),
x AS (SELECT a.*, (SELECT MIN(made) FROM i b WHERE b.doc_id = a.doc_id AND b.node = a.node + 1 AND a.node % 2 = 1) AS en,
  (SELECT MIN(made) FROM i b WHERE b.doc_id = a.doc_id AND b.made > a.made) AS dn FROM i a)"""


def _stage_items(t):
    items = lines(t).groupBy("doc_id", F.col("f").alias("node_id")).agg(F.min("shipped").alias("made"))
    edges = items.where("node_id % 2 = 1").select("doc_id", F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"))
    return items, edges


@query("next_stage_date", "M5", f"""WITH {_NODES_SQL} SELECT doc_id, node AS node_id, made, COALESCE(en, dn) AS next_date FROM x""")
def next_stage_date(t):
    return M.next_stage_dates(*_stage_items(t))


@query("test_date_window", "M6 N8", f"""WITH {_NODES_SQL},
w AS (SELECT doc_id, node % 3 AS stage, MIN(made) AS lower, MIN(COALESCE(en, dn)) AS upper FROM x GROUP BY ALL),
t AS (SELECT l_orderkey AS doc_id, l_linenumber AS f, CAST(l_shipdate AS DATE) + {SHIFT} AS d, CAST(l_quantity AS INT) AS q FROM lineitem),
s AS (SELECT *, CASE f % 4 WHEN 0 THEN d WHEN 1 THEN DATE_TRUNC('month', d)::DATE WHEN 2 THEN d END AS lo,
  CASE f % 4 WHEN 0 THEN d + q WHEN 1 THEN (DATE_TRUNC('month', d) + INTERVAL 1 MONTH)::DATE - 1 WHEN 2 THEN d END AS hi FROM t)
SELECT s.doc_id, f AS test_id, CASE WHEN lo IS NULL THEN 'HOLD' WHEN lo >= lower AND (upper IS NULL OR hi < upper) THEN 'PASS' ELSE 'FAIL' END AS status, COUNT(*) AS n
FROM s JOIN w ON w.doc_id = s.doc_id AND w.stage = s.f % 3 GROUP BY ALL""")
def test_date_window(t):
    windows = M.next_stage_dates(*_stage_items(t)).select("doc_id", (F.col("node_id") % 3).alias("stage_key"), F.col("made").alias("lower"), F.col("next_date").alias("upper"))
    k = F.col("f") % 4
    period = (F.when(k == 0, F.concat(dotted("shipped"), F.lit(" ~ "), F.date_format(F.date_add("shipped", F.col("q")), "yyyy-MM-dd")))
              .when(k == 1, F.date_format("shipped", "yyyy년 M월")).when(k == 2, F.date_format("shipped", "yyyy. M. d.")).otherwise("미정"))
    tests = lines(t).select("doc_id", F.col("f").alias("test_id"), (F.col("f") % 3).alias("stage_key"), period.alias("test_period"))
    return M.test_date_window(tests, windows).groupBy("doc_id", "test_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("stage_verdicts", "M7", """
WITH r AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey % 4 AS stage, l_linenumber % 3 AS field FROM lineitem),
c AS (SELECT l_orderkey AS doc_id, l_partkey % 4 AS stage, l_linenumber % 3 AS field, MAX(CASE WHEN l_quantity > 40 THEN 3 ELSE 1 END) AS s FROM lineitem GROUP BY ALL),
j AS (SELECT COALESCE(r.doc_id, c.doc_id) AS doc_id, COALESCE(r.stage, c.stage) AS stage, s FROM r FULL JOIN c ON r.doc_id = c.doc_id AND r.stage = c.stage AND r.field = c.field)
SELECT doc_id, stage, CASE MAX(COALESCE(s, 2)) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'HOLD' ELSE 'PASS' END AS status, COUNT(*) AS fields, COUNT(*) FILTER (s IS NULL) AS unseen FROM j GROUP BY ALL""")
def stage_verdicts(t):
    base = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("field"), "l_suppkey", "l_partkey", "l_quantity")
    required = base.select("doc_id", (F.col("l_suppkey") % 4).alias("stage"), "field")
    compared = base.select("doc_id", (F.col("l_partkey") % 4).alias("stage"), "field", F.when(F.col("l_quantity") > 40, "FAIL").otherwise("PASS").alias("status"))
    return M.stage_verdicts(required, compared)


@query("fuzzy_stages", "A3 N13")
def fuzzy_stages(t):
    names = ["CHO 마스터 세포주", "E.colli 제조용 세포주", "컴포넌트 A 중간체 원액", "Component B 중간체원액", "최종  원액", "완제 의약품", "나노피티클"]
    variants = ["CHOL 마스터세포주 시험", "E.coli 제조용세포주", "Component A 원액", "component b 중간체", "최종원액(1)", "완제의약품 기준", "나노 파티클 원액", "기타"]
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), (n % len(xs)).cast("int"))
    labels = t.orders.select(F.col("o_custkey").alias("doc_id"), pick(variants, F.col("o_orderkey")).alias("label")).distinct()
    stages = t.customer.select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.array(*[F.lit(x) for x in names])).alias("position", "stage"))
    return M.fuzzy_stages(labels, stages).withColumn("score", F.round("score", 6))
