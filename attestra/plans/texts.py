"""Lines, sections, chunks and tables out of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly as A
from ..operators import intervals as I
from ..operators import lines as L
from ..operators import tables as B
from ..operators.tree import tree_nodes
from .registry import query

SPLIT_SQL = """s AS (SELECT doc_id, STRING_SPLIT(REPLACE(text, CHR(13), CHR(10)), CHR(10)) AS ls FROM documents),
raw AS (SELECT doc_id, UNNEST(RANGE(LEN(ls))) AS line_no, UNNEST(ls) AS raw FROM s)"""


def doc_lines(t):
    return L.explode_lines(t.wide("documents", "doc_id", "text"), ["doc_id"])


@query("lines_clean", "T1 T2", f"""WITH {SPLIT_SQL},
c AS (SELECT doc_id, REGEXP_REPLACE(REGEXP_REPLACE(TRANSLATE(raw, CHR(160) || CHR(12288), '  '), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS line FROM raw)
SELECT doc_id, COUNT(*) AS lines, CAST(SUM(LENGTH(line)) AS BIGINT) AS chars FROM c
WHERE line <> '' AND NOT REGEXP_FULL_MATCH(line, '[:：]|--?|-?\\s*\\d+\\s*-?|\\d+\\s*/\\s*\\d+(\\s*페이지)?|\\d+\\.|:?\\s*페이지')
  AND NOT REGEXP_FULL_MATCH(line, '[_\\-.·\\s]{{3,}}|([_\\-.·]{{2,}}\\s*)+') GROUP BY doc_id""")
def lines_clean(t):
    kept = L.clean_lines(doc_lines(t))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


def numbered_lines(t):
    """Every fourth line becomes a numbered heading whose depth and number follow from the line number."""
    n = F.col("line_no")
    depth = (F.floor(n / 4) % 3 + 1).cast("int")
    parts = F.slice(F.array((n % 9 + 1), (n % 7 + 1), (n % 5 + 1)), F.lit(1), depth)
    number = F.array_join(F.transform(parts, lambda p: p.cast("string")), ".")
    title = F.concat(F.lit("Part "), n)
    line = F.when(n % 4 != 0, F.concat(F.lit("· "), F.col("raw"))).when(depth == 1, F.concat(number, F.lit(". "), title)).otherwise(F.concat(number, F.lit(" "), title))
    return doc_lines(t).withColumn("line", line).withColumn("heading", T.heading(F.col("line")))


HEADS_SQL = f"""{SPLIT_SQL},
h AS (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 0 THEN (line_no // 4) % 3 + 1 END AS depth,
  CASE WHEN line_no % 4 = 0 THEN ARRAY_TO_STRING(LIST_SLICE([line_no % 9 + 1, line_no % 7 + 1, line_no % 5 + 1], 1, (line_no // 4) % 3 + 1), '.') END AS number
  FROM raw)"""


@query("sections", "T5 T8", f"""WITH {HEADS_SQL}
SELECT doc_id, line_no, LAST_VALUE(number IGNORE NULLS) OVER w AS number, CAST(LAST_VALUE(depth IGNORE NULLS) OVER w AS INT) AS depth
FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""")
def sections(t):
    spanned = L.sections(numbered_lines(t).select("doc_id", "line_no", "block", "heading"), ["doc_id"], ["line_no"])
    return spanned.select("doc_id", "line_no", "section.number", "section.depth")


_PATH_SQL = f"""{HEADS_SQL},
d AS (SELECT *, MAX(CASE WHEN depth = 1 THEN line_no END) OVER w AS p1, MAX(CASE WHEN depth = 2 THEN line_no END) OVER w AS p2,
  MAX(CASE WHEN depth = 3 THEN line_no END) OVER w AS p3 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
v AS (SELECT doc_id, line_no, depth, p1, CASE WHEN p2 > COALESCE(p1, -1) THEN p2 END AS p2,
  CASE WHEN p3 > COALESCE(p1, -1) AND p3 > COALESCE(p2, -1) THEN p3 END AS p3 FROM d)"""


@query("section_paths", "T9", f"""WITH {_PATH_SQL}
SELECT doc_id, line_no, CONCAT_WS('>', p1, p2, p3) AS path FROM v""")
def section_paths(t):
    lines = numbered_lines(t).select("doc_id", "line_no", "block", "heading")
    paths = L.section_paths(lines, ["doc_id"], "line_no")
    return paths.select("doc_id", "line_no", F.array_join(F.transform("path", lambda p: p["pos"].cast("string")), ">").alias("path"))


@query("descendants", "P2", f"""WITH {HEADS_SQL}, c AS (SELECT doc_id, line_no, depth FROM h WHERE depth IS NOT NULL),
e AS (SELECT a.*, (SELECT MIN(line_no) FROM c b WHERE b.doc_id = a.doc_id AND b.line_no > a.line_no AND b.depth <= a.depth) AS stop FROM c a)
SELECT e.doc_id, e.line_no AS ancestor, COUNT(*) AS members, MAX(c.line_no) AS last_member
FROM e JOIN c ON c.doc_id = e.doc_id AND c.line_no >= e.line_no AND (stop IS NULL OR c.line_no < stop) GROUP BY ALL""")
def descendants(t):
    lines = numbered_lines(t).select("doc_id", "line_no", "block", "heading")
    chunks = L.section_paths(lines, ["doc_id"], "line_no").where("heading is not null")
    members = L.descendants(chunks.select("doc_id", "path", F.col("line_no").alias("position"), F.lit("").alias("text")), ["doc_id"])
    return members.groupBy("doc_id", "ancestor").agg(F.count(F.lit(1)).alias("members"), F.max("position").alias("last_member"))


@query("section_tree", "T22", f"""WITH {_PATH_SQL},
n AS (SELECT doc_id, line_no, p1 AS node, NULL AS parent, 1 AS level FROM v WHERE p1 IS NOT NULL AND depth IS NULL
  UNION ALL SELECT doc_id, line_no, p2, p1, CASE WHEN p1 IS NULL THEN 1 ELSE 2 END FROM v WHERE p2 IS NOT NULL AND depth IS NULL
  UNION ALL SELECT doc_id, line_no, p3, COALESCE(p2, p1), 1 + (p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT FROM v WHERE p3 IS NOT NULL AND depth IS NULL)
SELECT doc_id, node, parent, CAST(level AS INT) AS level, COUNT(*) AS leaves,
  CASE WHEN BOOL_OR(line_no % 5 = 1) THEN 'FAIL' ELSE 'PASS' END AS status FROM n GROUP BY ALL""")
def section_tree(t):
    lines = numbered_lines(t).select("doc_id", "line_no", "block", "heading")
    leaves = L.section_paths(lines, ["doc_id"], "line_no").where("heading is null")
    nodes = tree_nodes(leaves.withColumn("status", F.when(F.col("line_no") % 5 == 1, "FAIL").otherwise("PASS")), ["doc_id"])
    return nodes.select("doc_id", "node", "parent", F.col("level").cast("int").alias("level"), "leaves", "status")


_KV = ["시험기준: {v} mg 이하", "시험 결과 {v} mg", "비 고 : {v}", "제조 담당: {v}", "- 주의: {v}", "양성대조군 시험결과 {v}", "시험방법"]


@query("kv_split", "T4 T6", """
WITH c AS (SELECT c_custkey, c_custkey % 7 AS k, CAST(c_nationkey AS VARCHAR) AS v FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN '시험기준' WHEN 1 THEN '시험결과' WHEN 2 THEN '비고' WHEN 3 THEN '제조 담당' END AS label,
  CASE k WHEN 0 THEN v || ' mg 이하' WHEN 1 THEN v || ' mg' WHEN 2 THEN v WHEN 3 THEN v END AS value,
  CASE k WHEN 0 THEN 'criteria' WHEN 1 THEN 'result' WHEN 2 THEN 'remarks' END AS field FROM c""")
def kv_split(t):
    line = F.replace(F.get(F.array(*[F.lit(x) for x in _KV]), (F.col("c_custkey") % 7).cast("int")), F.lit("{v}"), F.col("c_nationkey").cast("string"))
    rows = L.classify(t.wide("customer", "c_custkey", line.alias("line")))
    return rows.select("c_custkey", L.canonical_label(F.col("kv.key")).alias("label"), "kv.value", "field")


@query("broken_names", "T7", """
WITH RECURSIVE r AS (SELECT c_nationkey AS doc_id, c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 THEN '엔도톡신' || c_custkey WHEN c_custkey % 3 = 1 THEN '시험' ELSE '본문' END AS line FROM customer),
n AS (SELECT *, ROW_NUMBER() OVER w AS i, COALESCE(LEAD(line) OVER w = '시험', FALSE) AS cand, LEAD(line) OVER w AS nxt FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
walk AS (SELECT doc_id, i, pos, line, nxt, cand AS starts, FALSE AS taken FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, n.pos, n.line, n.nxt, n.cand AND NOT w.starts, w.starts FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.i = w.i + 1)
SELECT doc_id, pos, CASE WHEN starts THEN line || nxt ELSE line END AS line FROM walk WHERE NOT taken""")
def broken_names(t):
    k = F.col("c_custkey") % 3
    line = F.when(k == 0, F.concat(F.lit("엔도톡신"), "c_custkey")).when(k == 1, "시험").otherwise("본문")
    rows = t.customer.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("pos"), line.alias("line"), L.block_of(F.col("c_custkey")).alias("block"))
    return L.join_broken_names(rows, ["doc_id"], "pos").select("doc_id", "pos", "line")


@query("record_assembly", "T10 T11", """
SELECT o_custkey AS doc_id, o_orderkey * 8 AS order_idx, '항목' || (o_orderkey % 97) || '시험' AS test_name,
  CAST(o_custkey % 50 AS VARCHAR) || ' mg 이하' AS criteria,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 40) || ' mg' || CHR(10) || '재시험 ' || (o_orderkey % 41) || ' mg' ELSE (o_orderkey % 40) || ' mg' END AS result,
  '2024.01.' || LPAD((o_orderkey % 28 + 1)::VARCHAR, 2, '0') AS test_date, '보관 ' || (o_orderkey % 7) AS remarks,
  CASE WHEN o_orderkey % 3 <> 0 THEN '설명 문장' END AS narrative
FROM orders WHERE o_orderkey % 5 <> 0""")
def record_assembly(t):
    o, name = F.col("o_orderkey"), F.concat(F.lit("항목"), F.col("o_orderkey") % 97, F.lit("시험"))
    filled = F.array(
        F.struct(F.lit(0).alias("k"), name.alias("line")), F.struct(F.lit(1).alias("k"), F.concat(F.lit("기 준: "), F.col("o_custkey") % 50, F.lit(" mg 이하")).alias("line")),
        F.struct(F.lit(2).alias("k"), F.concat(F.lit("시험결과 "), o % 40, F.lit(" mg")).alias("line")),
        F.struct(F.lit(3).alias("k"), F.concat(F.lit("시험결과: "), o % 40, F.lit(" mg")).alias("line")),
        F.struct(F.lit(4).alias("k"), F.when(o % 3 == 0, F.concat(F.lit("결과: 재시험 "), o % 41, F.lit(" mg"))).otherwise("설명 문장").alias("line")),
        F.struct(F.lit(5).alias("k"), F.concat(F.lit("시험일자: 2024.01."), F.lpad((o % 28 + 1).cast("string"), 2, "0")).alias("line")),
        F.struct(F.lit(6).alias("k"), F.concat(F.lit("비 고: 보관 "), o % 7).alias("line")))
    # every fifth order is a bare name without fields
    body = F.when(o % 5 == 0, F.slice(filled, F.lit(1), F.lit(1))).otherwise(filled)
    lines = t.wide("orders", "o_orderkey", "o_custkey").select(F.col("o_custkey").alias("doc_id"), F.explode(body).alias("b"), o.alias("o")).select(
        "doc_id", (F.col("o") * 8 + F.col("b.k")).alias("position"), "b.line").withColumn("block", L.block_of(F.col("position"), 65536))
    typed = L.classify(lines).withColumn("starts", L.is_test_name(F.col("line")))
    records = L.drop_empty_records(L.assemble_records(typed, ["doc_id"], "position"))
    return records.select("doc_id", "order_idx", "test_name", "criteria", "result", "test_date", "remarks", "narrative")


_ASSEMBLY_SQL = """l AS (
  SELECT o_custkey AS doc_id, o_orderkey * 16 + k AS pos, kind, field, CASE kind WHEN 'head' THEN (o_orderkey % 9 + 1) || '.' || (o_orderkey % 4 + 1) END AS number,
    CASE k WHEN 0 THEN '제조 기록' || (o_orderkey % 5) WHEN 1 THEN '본문 ' || (o_orderkey % 7) WHEN 2 THEN '항목' || (o_orderkey % 97) || '시험' WHEN 3 THEN (o_custkey % 50) || ' mg 이하'
      WHEN 4 THEN (o_orderkey % 40) || ' mg' WHEN 5 THEN '구분 | 값' WHEN 6 THEN '가 | ' || (o_orderkey % 11) WHEN 7 THEN '설명 문장' WHEN 8 THEN '나 | ' || (o_orderkey % 13) ELSE (o_orderkey % 40) || ' mg' END AS value,
    CASE k WHEN 3 THEN '기준: ' WHEN 4 THEN '시험결과: ' WHEN 9 THEN '시험결과: ' ELSE '' END AS label
  FROM orders, (VALUES (0, 'head', NULL, 3, 0), (1, 'text', NULL, 2, 0), (2, 'name', NULL, 5, 1), (3, 'field', 'criteria', 5, 2), (4, 'field', 'result', 5, 2), (5, 'table', NULL, 4, 0), (6, 'table', NULL, 4, 0),
    (7, 'text', NULL, 7, 0), (8, 'table', NULL, 8, 0), (9, 'field', 'result', 6, 0)) v(k, kind, field, modulus, way)
  WHERE CASE way WHEN 0 THEN o_orderkey % modulus = 0 WHEN 1 THEN o_orderkey % 5 <> 1 ELSE o_orderkey % 5 <> 0 END),
w AS (SELECT *, label || value AS line, LAST_VALUE(CASE WHEN kind = 'head' THEN number END IGNORE NULLS) OVER win AS section_number, LAST_VALUE(CASE WHEN kind = 'head' THEN value END IGNORE NULLS) OVER win AS section_title,
    COALESCE(LAST_VALUE(CASE WHEN kind IN ('head', 'name') THEN pos END IGNORE NULLS) OVER win, -1) AS owner_pos, LAST_VALUE(CASE WHEN kind IN ('head', 'name') THEN kind END IGNORE NULLS) OVER win AS owner,
    LAST_VALUE(CASE WHEN kind IN ('head', 'name') THEN value END IGNORE NULLS) OVER win AS name, LAST_VALUE(CASE WHEN kind <> 'table' THEN pos END IGNORE NULLS) OVER win AS table_run
  FROM l WINDOW win AS (PARTITION BY doc_id ORDER BY pos)),
body AS (SELECT * FROM w WHERE kind NOT IN ('head', 'name')),
lab AS (SELECT doc_id, owner_pos, field, value, MIN(pos) AS pos FROM body WHERE owner = 'name' AND kind = 'field' GROUP BY ALL),
tab AS (SELECT doc_id, owner_pos, table_run, MIN(pos) AS pos, STRING_AGG(line, CHR(10) ORDER BY pos) AS value FROM body WHERE owner = 'name' AND kind = 'table' GROUP BY ALL),
items AS (SELECT doc_id, owner_pos, field AS what, value, pos FROM lab UNION ALL SELECT doc_id, owner_pos, 'table', value, pos FROM tab UNION ALL SELECT doc_id, owner_pos, 'narrative', line, pos FROM body WHERE owner = 'name' AND kind = 'text'),
tests AS (SELECT i.doc_id, i.owner_pos AS first_pos, 'test' AS record_type, w.section_number, w.section_title, w.name AS test_name, STRING_AGG(i.value, CHR(10) ORDER BY i.pos) FILTER (what = 'criteria') AS criteria,
    NULLIF(CONCAT_WS(CHR(10), STRING_AGG(i.value, CHR(10) ORDER BY i.pos) FILTER (what = 'result'), STRING_AGG(i.value, CHR(10) ORDER BY i.pos) FILTER (what = 'table')), '') AS result,
    STRING_AGG(i.value, CHR(10) ORDER BY i.pos) FILTER (what = 'narrative') AS narrative, COUNT(*) FILTER (what = 'table') AS tables, NULL AS content
  FROM items i JOIN w ON w.doc_id = i.doc_id AND w.pos = i.owner_pos GROUP BY i.doc_id, i.owner_pos, w.section_number, w.section_title, w.name),
texts AS (SELECT doc_id, MIN(pos) AS first_pos, 'content' AS record_type, section_number, section_title, NULL, NULL, NULL, NULL, 0, STRING_AGG(line, CHR(10) ORDER BY pos)
  FROM body WHERE COALESCE(owner, 'head') = 'head' GROUP BY doc_id, owner_pos, pos // 65536, section_number, section_title)"""


@query("section_records", "T10 T11", f"""WITH {_ASSEMBLY_SQL}
SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY first_pos) - 1 AS order_idx, record_type, section_number, section_title, test_name, criteria, result, narrative, tables, content
FROM (SELECT * FROM tests UNION ALL SELECT * FROM texts)""")
def section_records(t):
    """Headings between tests, tables in tests and in sections, names without fields and lines before any heading."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    staged = [(o % 3 == 0, say(o % 9 + 1, ".", o % 4 + 1, " 제조 기록", o % 5)), (o % 2 == 0, say("본문 ", o % 7)), (o % 5 != 1, say("항목", o % 97, "시험")), (o % 5 != 0, say("기준: ", c % 50, " mg 이하")),
              (o % 5 != 0, say("시험결과: ", o % 40, " mg")), (o % 4 == 0, F.lit("구분 | 값")), (o % 4 == 0, say("가 | ", o % 11)), (o % 7 == 0, F.lit("설명 문장")), (o % 8 == 0, say("나 | ", o % 13)),
              (o % 6 == 0, say("시험결과: ", o % 40, " mg"))]
    rows = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.when(there, line).alias("line")) for k, (there, line) in enumerate(staged)]), lambda r: r["line"].isNotNull())
    lines = t.wide("orders", "o_orderkey", "o_custkey").select(c.alias("doc_id"), o.alias("o"), F.explode(rows).alias("r")).select("doc_id", (F.col("o") * 16 + F.col("r.k")).alias("position"), "r.line")
    typed = L.classify(lines.withColumn("block", L.block_of(F.col("position"), 65536))).withColumn("starts", L.is_test_name(F.col("line")))
    return A.section_records(typed, ["doc_id"], "position").select("doc_id", "order_idx", "record_type", "section_number", "section_title", "test_name", "criteria", "result", "narrative", "tables", "content")


@query("chunk_pack", "T19", """
WITH RECURSIVE p AS (SELECT doc_id, LIST_FILTER(LIST_TRANSFORM(STRING_SPLIT(REPLACE(text, CHR(13), CHR(10)), CHR(10)),
    lambda x: REGEXP_REPLACE(REGEXP_REPLACE(TRANSLATE(x, CHR(160) || CHR(12288), '  '), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
f AS (SELECT doc_id, ps, 0 AS i, 0 AS open_len, CAST(0 AS BIGINT) AS done FROM p
  UNION ALL
  SELECT doc_id, ps, i + 1,
    CASE WHEN LENGTH(ps[i + 1]) > 600 THEN 0 WHEN open_len > 0 AND open_len + 1 + LENGTH(ps[i + 1]) > 600 THEN LENGTH(ps[i + 1])
      WHEN open_len = 0 THEN LENGTH(ps[i + 1]) ELSE open_len + 1 + LENGTH(ps[i + 1]) END,
    CASE WHEN LENGTH(ps[i + 1]) > 600 THEN done + (CASE WHEN open_len > 0 THEN 1 ELSE 0 END) + CAST(CEIL(LENGTH(ps[i + 1]) / 600.0) AS BIGINT)
      WHEN open_len > 0 AND open_len + 1 + LENGTH(ps[i + 1]) > 600 THEN done + 1 ELSE done END
  FROM f WHERE i < LEN(ps))
SELECT doc_id, done + (CASE WHEN open_len > 0 THEN 1 ELSE 0 END) AS chunks FROM f WHERE i = LEN(ps)""")
def chunk_pack(t):
    spread = F.replace(F.replace("text", F.lit("\r"), F.lit("\n")), F.lit("\n"), F.lit("\n \n"))
    docs = t.wide("documents", "doc_id", "text")
    return docs.select("doc_id", F.size(L.pack_paragraphs(spread, 600)).cast("bigint").alias("chunks"))


@query("text_quality", "T13 T14", """
WITH d AS (SELECT doc_id, lang, text || CASE WHEN doc_id % 4 = 0 THEN REPEAT(CHR(65533) || 'a', 1 + LENGTH(text) // 10) ELSE '' END AS t,
  LENGTH(REGEXP_REPLACE(REGEXP_REPLACE(text, '[\\x00-\\x7f]', '', 'g'), '[^\\p{L}]', '', 'g')) AS letters, LENGTH(REGEXP_REPLACE(text, '[^가-힣]', '', 'g')) AS hangul,
  REGEXP_MATCHES(text, '[ÃÂâ][^\\s]{1,3}') AS moji FROM documents),
q AS (SELECT doc_id, t = '' OR doc_id % 4 = 0 OR moji OR (letters >= 8 AND hangul < 0.12 * letters) AS corrupt FROM d)
SELECT doc_id, CASE WHEN NOT corrupt THEN 'native' WHEN doc_id % 3 = 0 THEN 'scan' ELSE 'unreadable' END AS source FROM q""")
def text_quality(t):
    broken = F.repeat(F.lit("�a"), (F.lit(1) + F.floor(F.length("text") / 10)).cast("int"))
    native = F.when(F.col("doc_id") % 4 == 0, F.concat("text", broken)).otherwise(F.col("text"))
    scanned = F.when(F.col("doc_id") % 3 == 0, "허가서 본문 시험기준").otherwise("scan")
    docs = t.wide("documents", "doc_id", "text")
    return docs.select("doc_id", T.choose_page_text(native, scanned)["source"].alias("source"))


_LABELS_SQL = """l AS (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 4 = 3 THEN turn ELSE turn + 1 END AS number, conv_id % 3 + 3 AS total FROM conversations)"""


@query("page_gaps", "T23", f"""WITH {_LABELS_SQL},
s AS (SELECT *, LAG(number) OVER (PARTITION BY doc_id, total ORDER BY turn) AS before FROM l),
f AS (SELECT doc_id, total, COUNT(*) AS labels, BOOL_OR(COALESCE(before >= number, FALSE)) AS non_increasing,
  COUNT(*) FILTER (number < 1 OR number > total) AS out_of_range FROM s GROUP BY ALL),
i AS (SELECT doc_id, total, number, COUNT(*) AS n FROM l WHERE number BETWEEN 1 AND total GROUP BY ALL),
g AS (SELECT *, LAG(number) OVER (PARTITION BY doc_id, total ORDER BY number) AS below FROM i),
o AS (SELECT doc_id, total, COUNT(*) AS observed, COUNT(*) FILTER (n > 1) AS duplicates,
  COUNT(*) FILTER (number > COALESCE(below, 0) + 1) + CASE WHEN MAX(number) < total THEN 1 ELSE 0 END AS missing_ranges FROM g GROUP BY doc_id, total)
SELECT f.doc_id, f.total, labels, non_increasing, out_of_range, COALESCE(observed, 0) AS observed, COALESCE(duplicates, 0) AS duplicates,
  COALESCE(missing_ranges, 1) AS missing_ranges FROM f LEFT JOIN o USING (doc_id, total)""")
def page_gaps(t):
    text = F.concat(F.when(F.col("turn") % 4 == 3, F.col("turn")).otherwise(F.col("turn") + 1), F.lit(" / "), F.col("conv_id") % 3 + 3)
    pages = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), text.alias("text"))
    labels = pages.select("doc_id", "position", F.regexp_extract("text", r"^(\d+)\s*/\s*(\d+)$", 1).cast("bigint").alias("number"),
                          F.regexp_extract("text", r"^(\d+)\s*/\s*(\d+)$", 2).cast("bigint").alias("total"))
    return L.page_label_audit(labels)


@query("cue_scan", "T24", """
WITH c AS (SELECT doc_id, term, UNNEST(REGEXP_EXTRACT_ALL(text, pattern)) AS quote
  FROM documents, (VALUES ('the on', 't\\s*h\\s*e\\s*o\\s*n'), ('ention', 'e\\s*n\\s*t\\s*i\\s*o\\s*n'), ('ai', 'a\\s*i')) v(term, pattern))
SELECT doc_id, term, COUNT(*) AS hits, CAST(SUM(LENGTH(quote)) AS BIGINT) AS quoted, TRUE AS exact FROM c GROUP BY ALL""")
def cue_scan(t):
    docs = t.wide("documents", "doc_id", "text")
    hits = L.cue_hits(docs.select("doc_id", "text"), ["doc_id"], ["the on", "ention", "ai"])
    joined = hits.hint("merge").join(docs.select("doc_id", "text"), "doc_id")  # neither texts nor hits go through the driver
    exact = F.substr("text", F.col("char_start") + 1, F.length("quote")) == F.col("quote")
    return joined.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.length("quote")).alias("quoted"), F.bool_and(exact).alias("exact"))


@query("cue_owners", "T24", """
WITH c AS (SELECT doc_id, term, STRING_SPLIT_REGEX(text, pattern) AS gaps, REGEXP_EXTRACT_ALL(text, pattern) AS quotes
  FROM documents, (VALUES ('ention', 'e\\s*n\\s*t\\s*i\\s*o\\s*n'), ('ai', 'a\\s*i')) v(term, pattern)),
x AS (SELECT doc_id, term, UNNEST(RANGE(1, LEN(quotes) + 1)) AS k, UNNEST(gaps[1:LEN(quotes)]) AS gap, UNNEST(quotes) AS quote FROM c),
h AS (SELECT doc_id, term, SUM(LENGTH(gap) + LENGTH(quote)) OVER w - LENGTH(quote) AS char_start, SUM(LENGTH(gap) + LENGTH(quote)) OVER w AS char_end
  FROM x WINDOW w AS (PARTITION BY doc_id, term ORDER BY k)),
s AS (SELECT doc_id, i // 10 AS node_id, i AS span_id, 100 * i AS span_start, 100 * i + 90 AS span_end FROM (SELECT doc_id, UNNEST(RANGE(0, LENGTH(text) // 100 + 1)) AS i FROM documents)
  UNION ALL SELECT doc_id, -1, -1, 0, LENGTH(text) FROM documents WHERE doc_id % 3 = 0)
SELECT h.doc_id, term, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, COUNT(DISTINCT node_id) AS nodes,
  COALESCE(STRING_AGG(span_id, ',' ORDER BY span_start, span_end, span_id), '') AS spans, COUNT(span_id) > 0 AS owned
FROM h LEFT JOIN s ON s.doc_id = h.doc_id AND span_start < char_end AND span_end > char_start GROUP BY ALL""")
def cue_owners(t):
    """Cues with the sections they stand in: short spans with gaps between them and, in every third text, one over the whole of it."""
    docs = t.wide("documents", "doc_id", "text")
    hits = L.cue_hits(docs, ["doc_id"], ["ention", "ai"])
    size = F.length("text")
    grid = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(size / 100))).alias("i"))
    short = grid.select("doc_id", F.floor(F.col("i") / 10).alias("node_id"), F.col("i").alias("span_id"), (F.col("i") * 100).alias("span_start"), (F.col("i") * 100 + 90).alias("span_end"))
    whole = docs.where("doc_id % 3 = 0").select("doc_id", *[F.lit(x).cast("bigint").alias(c) for c, x in (("node_id", -1), ("span_id", -1), ("span_start", 0))], size.cast("bigint").alias("span_end"))
    owned = I.owning_spans(hits, short.unionByName(whole), ["doc_id"])
    return owned.select("doc_id", "term", F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"), F.size("node_ids").alias("nodes"), F.array_join("span_ids", ",").alias("spans"), "owned")


@query("evidence_units", "T21", """
WITH c AS (SELECT doc_id, text, UNNEST(RANGE(1, LENGTH(text) + 1)) AS i FROM (SELECT doc_id, REPLACE(REPLACE(text, CHR(10), ' '), CHR(13), ' ') AS text FROM documents)),
b AS (SELECT doc_id, i, LENGTH(text) AS n, SUBSTR(text, i, 1) AS ch, SUBSTR(text, i - 1, 1) AS a, SUBSTR(text, i + 1, 1) AS z FROM c)
SELECT doc_id, 1 + COUNT(*) FILTER (i < n AND (ch IN (';', '；', '。', '!', '?', '！', '？')
  OR (ch IN (',', '，') AND NOT (i > 1 AND REGEXP_MATCHES(a, '\\d') AND REGEXP_MATCHES(z, '\\d')))
  OR (ch = '.' AND i > 1 AND a IN ('다', '함', '됨', '음') AND REGEXP_MATCHES(z, '\\s')))) AS units, TRUE AS lossless FROM b GROUP BY doc_id""")
def evidence_units(t):
    flat = F.translate("text", "\n\r", "  ")
    docs = t.wide("documents", "doc_id", flat.alias("text"))
    units = docs.withColumn("units", L.evidence_units(F.col("text")))
    return units.select("doc_id", F.size("units").cast("bigint").alias("units"), (F.array_join("units", "") == F.col("text")).alias("lossless"))


def lot_tables(t):
    """A three-row lot table per order, written as pipe text; in even orders the second row is broken over two lines."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")

    def row(i, result_value):
        return F.concat(F.lit("L"), o % 1000 + i, F.lit(f" | 2024.0{i} | "), result_value)
    second = F.when(o % 2 == 0, F.concat(F.lit("L"), o % 1000 + 2, F.lit(" | 2024.02\n.15 | "), c % 50, F.lit(" mg"))).otherwise(row(2, F.concat(c % 50, F.lit(" mg"))))
    text = F.concat_ws("\n", F.lit("로트번호 | 시험일 | 시험 결과"), F.lit("--- | --- | ---"), row(1, F.concat(c % 40, F.lit(" mg"))), second,
                       row(3, F.when(o % 3 == 0, "").otherwise("적합")), F.lit("※ 주석 | 표 밖"))
    return t.wide("orders", "o_orderkey", "o_custkey").select(o.alias("doc_id"), text.alias("text"))


_LOTS_SQL = """
SELECT o_orderkey AS doc_id, i AS row_no, 'L' || (o_orderkey % 1000 + i) AS item_value,
  CASE WHEN i = 2 AND o_orderkey % 2 = 0 THEN '2024.02 .15' ELSE '2024.0' || i END AS test_date,
  CASE i WHEN 1 THEN (o_custkey % 40) || ' mg' WHEN 2 THEN (o_custkey % 50) || ' mg' ELSE '적합' END AS result
FROM orders, (VALUES (1), (2), (3)) v(i) WHERE NOT (i = 3 AND o_orderkey % 3 = 0)"""


@query("pipe_table", "B1 B3", _LOTS_SQL)
def pipe_table(t):
    parsed = lot_tables(t).withColumn("rows", B.pipe_rows(F.col("text")))
    return B.lot_rows(B.table_cells(parsed, ["doc_id"]), ["doc_id"])


@query("horizontal_table", "B2", """
SELECT o_orderkey AS doc_id, 'L' || i AS lot, CAST((o_custkey % 30) + i AS VARCHAR) || ' mg' AS result, '2024.0' || i AS date
FROM orders, (VALUES (1), (2)) v(i)""")
def horizontal_table(t):
    c = F.col("o_custkey") % 30
    text = F.concat(F.lit("로트번호 | L1 | L2\n시험일자 | 2024.01 | 2024.02\n시험결과 | "), c + 1, F.lit(" mg | "), c + 2, F.lit(" mg"))
    rows = t.wide("orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("doc_id"), F.explode(B.horizontal_lots(text)).alias("r"))
    return rows.select("doc_id", "r.*")


@query("table_kinds", "B4", """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'multi_test' WHEN 1 THEN 'transposed' ELSE 'supporting' END AS kind FROM orders""")
def table_kinds(t):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "시험항목 | 시험기준 | 시험결과\nA시험 | 1 | 2").when(k == 1, "구분 | 가 | 나\n시험항목 | A | B\n시험결과 | 1 | 2").otherwise("원료 | 분량\nA | 1")
    parsed = t.wide("orders", "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), B.pipe_rows(text).alias("rows"))
    return B.table_kind(B.table_cells(parsed, ["doc_id"]), ["doc_id"])


@query("table_transpose", "B5", """
SELECT o_orderkey AS doc_id, i AS col_no, 'T' || i AS test_name, CAST(o_custkey % 50 + i AS VARCHAR) AS result FROM orders, (VALUES (1), (2)) v(i)""")
def table_transpose(t):
    c = F.col("o_custkey") % 50
    text = F.concat(F.lit("구분 | a | b\n시험명 | T1 | T2\n결과 | "), c + 1, F.lit(" | "), c + 2)
    parsed = t.wide("orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("doc_id"), B.pipe_rows(text).alias("rows"))
    records = B.transpose(B.table_cells(parsed, ["doc_id"]), ["doc_id"], ["시험명", "결과"])
    return records.select("doc_id", "col_no", F.col("시험명").alias("test_name"), F.col("결과").alias("result"))


@query("table_expand", "B6", """
SELECT o_orderkey AS doc_id, ROUND(7 + i / 10000.0, 4) AS order_idx, CASE WHEN i = 2 AND o_orderkey % 5 = 0 THEN '12.5' ELSE 'T' || i || '시험' END AS test_name,
  (o_custkey % 50 + i) || ' mg' AS result, CASE WHEN i = 1 THEN '10 mg 이하' WHEN o_orderkey % 2 = 0 THEN '공통' END AS criteria,
  i = 2 AND o_orderkey % 2 = 1 AS needs_permit, o_orderkey % 5 = 0 AS warning FROM orders, (VALUES (1), (2)) v(i)""")
def table_expand(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey") % 50
    second = F.when(o % 5 == 0, "12.5").otherwise("T2시험")
    text = F.concat(F.lit("시험항목 | 시험기준 | 시험결과\nT1시험 | 10 mg 이하 | "), c + 1, F.lit(" mg\n"), second, F.lit(" | | "), c + 2, F.lit(" mg"))
    tables = t.wide("orders", "o_orderkey", "o_custkey").select(
        o.alias("doc_id"), F.lit(7.0).alias("order_idx"), F.when(o % 2 == 0, "공통").alias("criteria"), B.pipe_rows(text).alias("rows"))
    out = B.expand_tests(tables, B.table_cells(tables, ["doc_id"]), ["doc_id"])
    return out.withColumn("order_idx", F.round("order_idx", 4))


@query("agreed_period", "B8", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN '2024.05' END AS value, 2 AS rows FROM orders""")
def agreed_period(t):
    text = F.concat(F.lit("로트 | 시험일 | 결과\nA | 2024.05 | 1\nB | "), F.when(F.col("o_orderkey") % 2 == 0, "2024.05").otherwise("2024.06"), F.lit(" | 2"))
    parsed = t.wide("orders", "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), B.pipe_rows(text).alias("rows"))
    return B.agreed_value(B.table_cells(parsed, ["doc_id"]), ["doc_id"], "date")


@query("document_metadata", "T15", """
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '(주)' || c_mktsegment || '제약' END AS company,
  c_name AS title, 'LOT-' || c_nationkey AS product_no, '1.' || (c_custkey % 5) AS version, '2024.03.' || LPAD(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') AS received FROM customer""")
def document_metadata(t):
    c = F.col("c_custkey")
    company = F.when(c % 2 == 0, F.concat(F.lit("제조원 : "), "c_mktsegment")).otherwise(F.concat(F.lit("(주)"), "c_mktsegment", F.lit("제약")))
    page = F.concat_ws("\n", F.lit("표지"), company, F.concat(F.lit("제품명: "), "c_name"), F.concat(F.lit("제조번호: LOT-"), "c_nationkey"),
                       F.concat(F.lit("ver. 1."), c % 5), F.concat(F.lit("접수일: 2024.03."), F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0")))
    return t.wide("customer", "*").select(c.alias("doc_id"), L.document_metadata(page).alias("m")).select("doc_id", "m.*")


@query("control_fields", "T16", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 <> 2 THEN (o_custkey % 90) || ' μg/mL' END AS control_result,
  CASE WHEN o_orderkey % 3 = 0 THEN '150~200 μg/mL' END AS control_criteria FROM orders""")
def control_fields(t):
    k = F.col("o_orderkey") % 3
    remarks = F.concat_ws("\n", F.lit("일반 비고"), F.when(k != 2, F.concat(F.lit("양성대조군 시험결과 "), F.col("o_custkey") % 90, F.lit(" μg/mL"))),
                          F.when(k == 0, "양성대조군 기준: 150~200 μg/mL"))
    rows = t.wide("orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("doc_id"), L.control_fields(remarks).alias("c"))
    return rows.select("doc_id", F.col("c.result").alias("control_result"), F.col("c.criteria").alias("control_criteria"))


@query("split_rows", "T12", """
SELECT o_custkey AS doc_id, 'M' || (o_orderkey % 20) AS material, CASE WHEN o_orderkey % 3 = 0 THEN 'part one part two' ELSE 'part one' END AS component,
  'L' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '-02' ELSE '-' END AS lot, (o_orderkey % 70) || ' mL' AS amount FROM orders""")
def split_rows(t):
    o, blank = F.col("o_orderkey"), F.lit("")

    def row(k, *cells):
        return F.struct(F.lit(k).alias("k"), *[c.alias(n) for n, c in zip(("material", "component", "lot", "amount"), cells)])
    first = row(0, F.concat(F.lit("M"), o % 20), F.lit("part one"), F.concat(F.lit("L"), o, F.lit("-")), F.concat(o % 70, F.lit(" mL")))
    header = row(1, *[F.lit(x) for x in ("material", "component", "lot", "amount")])
    rest = F.when(o % 3 == 0, row(2, blank, F.lit("part two"), F.lit("02"), blank))
    cells = t.wide("orders", "o_orderkey", "o_custkey").select(F.col("o_custkey").alias("doc_id"), o, F.explode(F.array_compact(F.array(first, header, rest))).alias("r"))
    rows = cells.select("doc_id", (o * 4 + F.col("r.k")).alias("position"), "r.material", "r.component", "r.lot", "r.amount")
    return B.merge_split_rows(rows, "doc_id", ["material", "component", "lot", "amount"]).drop("row_no")
