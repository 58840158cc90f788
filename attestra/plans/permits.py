"""Licence sections, search, required tests, applicability and grounded responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines as L
from ..operators import permits as P
from ..operators import rules as R
from ..operators.rules import Rule
from .registry import query
from .ruling import OUTCOME_SQL, finish
from .texts import HEADS_SQL, numbered_lines

_PAGES_SQL = """p AS (SELECT source AS doc_id, doc_id AS page_no, doc_id % 10 = 9 AS form,
  CASE doc_id % 10 WHEN 9 THEN ['성상', '본문', '포장단위'] WHEN 0 THEN ['머리말', (doc_id % 7 + 1) || '. Part A', '내용']
    WHEN 5 THEN ['이어지는 글', '내용'] ELSE ['앞의 글', (doc_id % 7 + 1) || '.' || (doc_id % 3 + 1) || ' Part B', '내용', (doc_id % 7 + 1) || '.' || (doc_id % 3 + 1) || '.2 Part C', '내용'] END AS ls FROM documents),
lines AS (SELECT doc_id, page_no, form, UNNEST(RANGE(LEN(ls))) AS line_no, UNNEST(ls) AS line FROM p),
h AS (SELECT *, page_no * 1000000 + line_no AS position, CASE WHEN NOT form AND REGEXP_MATCHES(line, '^\\d') THEN
  CASE WHEN line LIKE '%Part A' THEN 1 WHEN line LIKE '%Part B' THEN 2 ELSE 3 END END AS depth FROM lines),
info AS (SELECT doc_id, page_no, BOOL_OR(form) AS form, ARG_MIN(depth, position) FILTER (depth IS NOT NULL) AS lead FROM h GROUP BY ALL),
f AS (SELECT *, LAG(form) OVER (PARTITION BY doc_id ORDER BY page_no) AS after_form FROM info),
m AS (SELECT h.*, depth IS NOT NULL OR (line_no = 0 AND (h.form OR COALESCE(after_form, FALSE) OR COALESCE(lead = 1, FALSE))) AS starts FROM h JOIN f USING (doc_id, page_no)),
c AS (SELECT *, SUM(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS chunk_no FROM m)"""


def permit_pages(t):
    """Pages of a source in document order: form pages, pages with a top-level section, continuations and subsections."""
    d = F.col("doc_id")
    sub_no = F.concat(d % 7 + 1, F.lit("."), d % 3 + 1)
    text = (F.when(d % 10 == 9, "성 상\n본문\n포장단위").when(d % 10 == 0, F.concat(F.lit("머리말\n"), d % 7 + 1, F.lit(". Part A\n내용")))
            .when(d % 10 == 5, "이어지는 글\n내용").otherwise(F.concat(F.lit("앞의 글\n"), sub_no, F.lit(" Part B\n내용\n"), sub_no, F.lit(".2 Part C\n내용"))))
    return t.wide("documents", F.col("source").alias("doc_id"), d.alias("page_no"), text.alias("text"))


@query("permit_sections", "P1 S2", f"""WITH {_PAGES_SQL}
SELECT doc_id, chunk_no, MIN(page_no) AS page_start, MAX(page_no) AS page_end, COUNT(*) AS lines,
  MAX(CASE WHEN depth IS NOT NULL THEN REGEXP_EXTRACT(line, '^[\\d.]*\\d') END) AS section_number,
  MAX(CASE WHEN depth IS NOT NULL THEN RIGHT(line, 6) END) AS title FROM c GROUP BY doc_id, chunk_no""")
def permit_sections(t):
    chunks = P.chunk_summary(P.permit_chunks(permit_pages(t)))
    return chunks.select("doc_id", "chunk_no", "page_start", "page_end", "lines", "section_number", "title")


def _search_sides(t):
    brand = F.concat(F.lit("Brand#"), F.col("c_nationkey") + 1)
    noun = F.get(F.array(*[F.lit(x) for x in ("ring", "1.2 Red  Widget", "bolt", "old", "4 small", "확인시험", "rod bolt")]), (F.col("c_custkey") % 7).cast("int"))
    stage = F.get(F.array(*[F.lit(x) for x in ("ECONOMY", "2. medium test", "PROMO 시험 LARGE", "XLARGE", "none")]), (F.col("c_custkey") % 5).cast("int"))
    records = t.wide("customer", F.col("c_custkey").alias("record_id"), brand.alias("permit_id"), noun.alias("test_name"), stage.alias("stage"))
    title = F.when(F.col("p_partkey") % 10 == 0, "확인 시험").otherwise(F.concat(F.col("p_size"), F.lit(". "), "p_name"))
    chunks = t.part.select(F.col("p_brand").alias("permit_id"), F.col("p_partkey").alias("chunk_no"), title.alias("title"), F.lower("p_type").alias("stage"))
    return records, chunks


_SEARCH_SQL = """r AS (SELECT c_custkey AS record_id, 'Brand#' || (c_nationkey + 1) AS permit_id,
  (['ring', 'redwidget', 'bolt', 'old', 'small', '확인시험', 'rodbolt'])[c_custkey % 7 + 1] AS a,
  (['economy', 'medium', 'promolarge', 'xlarge', 'none'])[c_custkey % 5 + 1] AS s FROM customer),
c AS (SELECT p_brand AS permit_id, p_partkey AS chunk_no, CASE WHEN p_partkey % 10 = 0 THEN '확인시험' ELSE REPLACE(p_name, ' ', '') END AS b, LOWER(p_type) AS cs FROM part),
n AS (SELECT record_id, r.permit_id, chunk_no, b, CASE WHEN a = b THEN 100.0 ELSE 60.0 END AS name_score,
  CASE WHEN s = cs THEN 100.0 WHEN CONTAINS(cs, s) THEN 80.0 WHEN CONTAINS(s, cs) THEN 20.0 + 30.0 * LENGTH(cs) / LENGTH(s) ELSE 0.0 END AS stage_score
  FROM r JOIN c ON r.permit_id = c.permit_id AND (CONTAINS(a, b) OR CONTAINS(b, a)))"""


@query("permit_search", "P3 A2", f"""WITH {_SEARCH_SQL},
k AS (SELECT *, name_score + stage_score AS score, ROW_NUMBER() OVER (PARTITION BY record_id ORDER BY name_score + stage_score DESC, chunk_no) AS rank
  FROM n WHERE NOT (b IN ('확인시험', '성상', '무균시험', '시험') AND stage_score = 0))
SELECT record_id, chunk_no, ROUND(CAST(score AS DOUBLE), 6) AS score, rank FROM k WHERE rank <= 3""")
def permit_search(t):
    found = P.permit_search(*_search_sides(t), top_k=3)
    return found.select("record_id", "chunk_no", F.round("score", 6).alias("score"), "rank")


@query("permit_ambiguity", "P4", f"""WITH {_SEARCH_SQL}
SELECT record_id, a = '확인시험' AND (SELECT COUNT(*) FROM c WHERE c.permit_id = r.permit_id AND c.b = '확인시험') > 1 AS ambiguous FROM r""")
def permit_ambiguity(t):
    return P.ambiguous_generic(*_search_sides(t)).select("record_id", "ambiguous")


@query("rule_permit_test", "R17", f"""WITH docs AS (SELECT c_custkey AS doc_id FROM customer), {_SEARCH_SQL},
k AS (SELECT record_id, b, chunk_no, ROW_NUMBER() OVER (PARTITION BY record_id ORDER BY name_score + stage_score DESC, chunk_no) AS rank
  FROM n WHERE NOT (b IN ('확인시험', '성상', '무균시험', '시험') AND stage_score = 0)),
g AS (SELECT record_id, COUNT(*) AS n, MIN(chunk_no) AS chunk_no FROM k WHERE rank <= 12 GROUP BY record_id),
checks AS (SELECT c_custkey AS doc_id, CASE WHEN COALESCE(n, 0) <> 1 THEN 'HOLD' WHEN chunk_no % 50 = c_custkey % 50 THEN 'PASS' ELSE 'FAIL' END AS status
  FROM customer LEFT JOIN g ON g.record_id = c_custkey)
{OUTCOME_SQL}""")
def rule_permit_test(t):
    records, chunks = _search_sides(t)
    found = P.permit_search(records, chunks, top_k=12)
    text = F.concat(F.lit("시험 조건: 배양 "), F.col("chunk_no") % 50, F.lit(" 일"))
    candidates = found.select(F.col("record_id").alias("doc_id"), F.lit(0.0).alias("order_idx"), text.alias("text"))
    tests = records.select(F.col("record_id").alias("doc_id"), F.lit(0.0).alias("order_idx"), F.lit("test").alias("record_type"),
                           F.concat(F.lit("배양 "), F.col("record_id") % 50, F.lit("일")).alias("method"))
    rule = Rule("A.9", "permit_test", {"type": "test"}, {"permit_pattern": r"배양\s*(\d+)\s*일", "sp_pattern": r"배양\s*(\d+)\s*일", "sp_attribute": "method"})
    return finish(tests, R.permit_test(tests, candidates, rule))


@query("permit_resolution", "P5", """
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN 1000 + k * 50 + c_nationkey WHEN n_regionkey <> 2 THEN n_nationkey END AS permit_id,
  CASE WHEN c_custkey % 4 = 0 THEN 'linked' WHEN n_nationkey IS NULL THEN 'none' WHEN n_regionkey = 2 THEN 'hash_mismatch' ELSE 'catalogue' END AS source
FROM customer JOIN (VALUES (0), (1)) v(k) ON k = 0 OR c_custkey % 8 = 0
LEFT JOIN nation ON c_nationkey = n_nationkey AND c_mktsegment <> 'MACHINERY'""")
def permit_resolution(t):
    docs = t.wide("customer", "*").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("nation_ "), "c_nationkey").alias("company"), F.initcap("c_mktsegment").alias("product"))
    links = t.customer.where(F.col("c_custkey") % 4 == 0).select(F.col("c_custkey").alias("doc_id"), F.explode(F.when(
        F.col("c_custkey") % 8 == 0, F.array(F.col("c_nationkey") + 1000, F.col("c_nationkey") + 1050)).otherwise(F.array(F.col("c_nationkey") + 1000))).alias("permit_id"))
    segments = t.customer.select("c_mktsegment").distinct().where("c_mktsegment <> 'MACHINERY'")
    digest = F.sha2(F.col("n_name"), 256)
    catalogue = t.nation.join(t.region.select("r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("company"), F.col("n_nationkey").alias("permit_id"), F.upper(digest).alias("expected_sha"),
        F.when(F.col("n_regionkey") == 2, F.lit("0")).otherwise(digest).alias("actual_sha"), F.explode(F.array(*[
            F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")])).alias("product"))
    return P.resolve_permits(docs, links, catalogue)


@query("permit_ownership", "P6", """
WITH s AS (SELECT doc_id, text, LENGTH(text) AS n FROM documents WHERE text <> '')
SELECT doc_id, CASE WHEN doc_id % 5 = 1 AND REGEXP_MATCHES(SUBSTR(text, n // 2 + 1, 3), '\\S') THEN 1 WHEN doc_id % 5 = 2 AND REGEXP_MATCHES(SUBSTR(text, n - 1), '\\S') AND n > 3 THEN 1 ELSE 0 END AS gaps,
  CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END AS overlaps, CASE WHEN doc_id % 5 = 4 THEN 1 ELSE 0 END AS bounds FROM s WHERE n > 12""")
def permit_ownership(t):
    d, n = F.col("doc_id") % 5, F.length("text")
    half = F.floor(n / 2).cast("int")
    second = F.when(d == 1, half + 3).when(d == 3, half - 1).otherwise(half)
    end = F.when(d == 2, n - 2).when(d == 4, n + 5).otherwise(n)
    pages = t.wide("documents", "doc_id", "text").where(n > 12)
    spans = pages.select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("char_start"), half.alias("char_end")), F.struct(second.alias("char_start"), end.alias("char_end")))).alias("s")).select("doc_id", "s.*")
    return P.ownership_errors(spans, pages, ["doc_id"])


@query("page_sequence", "P6", """
SELECT conv_id AS doc_id, MAX(turn) - MIN(turn) + 1 = COUNT(*) AS complete, COUNT(*) FILTER (TRIM(text) = '') AS empty FROM conversations WHERE turn <> conv_id % 4 GROUP BY conv_id""")
def page_sequence(t):
    pages = t.conversations.where("turn <> conv_id % 4").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return P.page_sequence_errors(pages, "doc_id")


@query("scope_leaves", "P7", f"""WITH {HEADS_SQL}, c AS (SELECT doc_id, line_no, depth, number FROM h WHERE depth IS NOT NULL),
x AS (SELECT *, LEAD(depth) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM c)
SELECT doc_id, COUNT(*) FILTER (nxt IS NULL OR nxt <= depth) AS leaves FROM x GROUP BY doc_id HAVING COUNT(*) FILTER (nxt IS NULL OR nxt <= depth) > 0""")
def scope_leaves(t):
    lines = numbered_lines(t).select("doc_id", "line_no", "block", "heading")
    chunks = L.section_paths(lines, ["doc_id"], "line_no").where("heading is not null").withColumnRenamed("line_no", "position")
    return P.scope_leaves(chunks, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("leaves"))


@query("content_hash", "N14 P7", """
WITH s AS (SELECT doc_id, STRING_SPLIT(REPLACE(text, CHR(13), CHR(10)), CHR(10)) AS ls FROM documents),
l AS (SELECT doc_id, UNNEST(RANGE(LEN(ls))) AS i, UNNEST(ls) AS line FROM s),
b AS (SELECT doc_id, i // 4 AS b, SHA256(STRING_AGG(line, CHR(10) ORDER BY i)) AS h FROM l GROUP BY ALL),
c AS (SELECT doc_id, b // 4 AS c, SHA256(STRING_AGG(h, CHR(10) ORDER BY b)) AS h FROM b GROUP BY ALL)
SELECT doc_id, SHA256(STRING_AGG(h, CHR(10) ORDER BY c)) AS digest FROM c GROUP BY doc_id""")
def content_hash(t):
    rows = L.explode_lines(t.wide("documents", "doc_id", "text"), ["doc_id"])
    return P.content_hash(rows, ["doc_id"], "line_no", F.col("raw"), size=4)


_PRESENCE_SQL = """g AS (SELECT o_orderkey AS doc_id, f AS test_key, b AS batch FROM (SELECT o_orderkey, o_custkey % 5 AS p FROM orders), (VALUES (1), (2), (3)) v(f),
  (SELECT DISTINCT l_orderkey, l_suppkey % 4 AS b FROM lineitem) WHERE l_orderkey = o_orderkey AND f <= p + 1),
l AS (SELECT l_orderkey AS doc_id, l_linenumber AS test_key, l_suppkey % 4 AS batch, l_partkey % 60 = 0 AS loose, l_quantity > 5 AS filled FROM lineitem),
r AS (SELECT doc_id, test_key, batch, COUNT(*) AS n, COUNT(*) FILTER (filled) AS filled FROM l WHERE NOT loose GROUP BY ALL),
u AS (SELECT DISTINCT doc_id FROM l WHERE loose),
presence AS (SELECT g.*, CASE WHEN n = 1 AND r.filled = 1 THEN 'PASS' WHEN n >= 1 THEN 'HOLD' WHEN u.doc_id IS NOT NULL OR (g.test_key = 3 AND g.doc_id % 10 = 0) THEN 'HOLD' ELSE 'FAIL' END AS status
  FROM g LEFT JOIN r USING (doc_id, test_key, batch) LEFT JOIN u ON u.doc_id = g.doc_id)"""


def _presence_inputs(t):
    scope = t.wide("orders", F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 5).alias("p"))
    tests = t.region.select(F.col("r_regionkey").cast("bigint").alias("p"), F.explode(F.sequence(F.lit(1), F.least(F.col("r_regionkey") + 1, F.lit(3)))).alias("test_key"))
    lines = t.wide("lineitem", F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("test_key"), (F.col("l_suppkey") % 4).alias("batch"),
                   (F.col("l_partkey") % 60 == 0).alias("loose"), F.when(F.col("l_quantity") > 5, "적합").otherwise(" ").alias("result"))
    grid = scope.join(tests, "p").select("doc_id", "test_key").join(lines.select("doc_id", "batch").distinct(), "doc_id")
    records = lines.where("not loose")
    linked = records.where("test_key = 3").groupBy("doc_id", "test_key").agg(F.count(F.lit(1)).alias("n"))
    mentions = scope.where("doc_id % 10 = 0").select("doc_id", F.lit(3).alias("test_key")).join(linked, ["doc_id", "test_key"], "left").select(
        "doc_id", "test_key", (F.coalesce("n", F.lit(0)) + 1).alias("mentions"))
    return grid, records, lines.where("loose"), mentions


@query("permit_presence", "P8 R5", f"WITH {_PRESENCE_SQL} SELECT doc_id, test_key, batch, status FROM presence")
def permit_presence(t):
    return P.presence(*_presence_inputs(t))


@query("permit_conditional", "P9 R6", f"""WITH {_PRESENCE_SQL}
SELECT doc_id, test_key, batch, CASE WHEN (doc_id + batch) % 6 = 0 THEN 'N/A' WHEN (doc_id + batch) % 6 IN (1, 2) THEN 'HOLD' ELSE status END AS status FROM presence""")
def permit_conditional(t):
    grid, records, loose, mentions = _presence_inputs(t)
    k = (F.col("doc_id") + F.col("batch")) % 6
    gates = grid.where(k != 2).withColumn("applicability", F.when(k == 0, "not_required").when(k == 1, "unknown").otherwise("required"))
    return P.presence(grid, records, loose, mentions, gates)


@query("applicability", "P10", """
WITH c AS (SELECT c_custkey AS target_id, c_nationkey % 5 AS stage, c_acctbal AS bal, CASE WHEN c_custkey % 8 = 0 THEN 'EUR' ELSE 'USD' END AS unit, c_custkey % 11 = 0 AS twice, c_custkey % 50 AS age FROM customer),
p AS (SELECT n_nationkey, n_regionkey, c.*, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN twice OR unit <> 'USD' THEN 'u' WHEN CAST(bal AS DECIMAL(18,2)) > n_nationkey * 100 THEN 't' ELSE 'f' END AS own,
  CASE WHEN n_regionkey = 4 THEN NULL WHEN age <= n_regionkey * 10 THEN 't' ELSE 'f' END AS parent FROM nation JOIN c ON n_regionkey = stage)
SELECT n_nationkey AS requirement_id, target_id, CASE WHEN own = 'u' OR parent = 'u' THEN 'unknown' WHEN own IS NULL AND parent IS NULL THEN 'required'
  WHEN n_nationkey % 2 = 0 THEN CASE WHEN COALESCE(own, 't') = 't' AND COALESCE(parent, 't') = 't' THEN 'required' ELSE 'not_required' END
  ELSE CASE WHEN COALESCE(own, 'f') = 't' OR COALESCE(parent, 'f') = 't' THEN 'required' ELSE 'not_required' END END AS applicability FROM p""")
def applicability(t):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    requirements = t.nation.select(n.alias("requirement_id"), r.alias("stage"), F.array(F.concat(F.lit("N"), n), F.concat(F.lit("R"), r)).alias("owners"),
                                   F.when(n % 2 == 0, "all").otherwise("any").alias("combine"))
    own = t.nation.where(n % 3 != 0).select(F.concat(F.lit("N"), n).alias("owner_id"), F.lit("balance").alias("field"), F.lit("gt").alias("operator"),
                                            (n * 100).cast("string").alias("value"), F.lit("USD").alias("unit"))
    parent = t.region.where("r_regionkey <> 4").select(F.concat(F.lit("R"), "r_regionkey").alias("owner_id"), F.lit("age").alias("field"), F.lit("lte").alias("operator"),
                                                       (F.col("r_regionkey") * 10).cast("string").alias("value"), F.lit("일").alias("unit"))
    conditions = own.unionByName(parent).withColumn("condition_id", F.concat_ws(":", "owner_id", "field"))
    c = F.col("c_custkey")
    base = t.wide("customer", "c_custkey", "c_nationkey", "c_acctbal")
    balance = F.concat(F.col("c_acctbal").cast("decimal(18,2)"), F.lit(" "), F.when(c % 8 == 0, "EUR").otherwise("USD"))
    values = F.array_compact(F.array(
        F.struct(F.lit("balance").alias("field"), balance.alias("raw_value")), F.when(c % 11 == 0, F.struct(F.lit("balance").alias("field"), balance.alias("raw_value"))),
        F.struct(F.lit("age").alias("field"), F.concat(c % 50, F.lit("일")).alias("raw_value"))))
    facts = base.select(c.alias("target_id"), F.explode(values).alias("v")).select("target_id", "v.*")
    targets = base.select(c.alias("target_id"), (F.col("c_nationkey") % 5).alias("stage"))
    return P.applicability(requirements, targets, conditions, facts)


@query("target_facts", "P11", """
WITH c AS (SELECT c_custkey, c_nationkey, '제조단계: S' || (c_nationkey % 5) || CHR(10) || '제조번호: B' || c_custkey || CHR(10) AS head FROM customer WHERE c_custkey % 9 <> 0)
SELECT c_custkey AS doc_id, 'S' || (c_nationkey % 5) AS stage, 'B' || c_custkey AS batch, v.field, CASE v.i WHEN 1 THEN c_nationkey || ' mL' ELSE '' END AS raw_value,
  LENGTH(head) + CASE v.i WHEN 1 THEN 0 ELSE LENGTH('접종량: ' || c_nationkey || ' mL') + 1 END AS char_start
FROM c, (VALUES (1, '접종량'), (2, '배양일')) v(i, field)""")
def target_facts(t):
    c = F.col("c_custkey")
    batch = F.when(c % 9 == 0, F.lit("TBD")).otherwise(F.concat(F.lit("B"), c))
    text = F.concat(F.lit("제조단계: S"), F.col("c_nationkey") % 5, F.lit("\n제조번호: "), batch, F.lit("\n접종량: "), F.col("c_nationkey"), F.lit(" mL\n배양일\n접종량비율: 3"))
    pages = t.wide("customer", c.alias("doc_id"), F.lit(1).alias("page_no"), text.alias("text"))
    return P.page_targets(pages, ["접종량", "배양일"]).select("doc_id", "stage", "batch", "field", "raw_value", "char_start")


@query("response_validation", "P12", """
WITH b AS (SELECT o_custkey AS contract_id, o_orderkey FROM orders),
bad AS (SELECT contract_id, BOOL_OR(o_orderkey % 97 IN (0, 1, 2)) AS rejected FROM b GROUP BY contract_id)
SELECT contract_id, o_orderkey AS requirement_id, NOT rejected AS accepted, CASE WHEN rejected THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN 'required' ELSE 'not_required' END AS applicability
FROM b JOIN bad USING (contract_id)""")
def response_validation(t):
    o = F.col("o_orderkey")
    expected = t.wide("orders", F.col("o_custkey").alias("contract_id"), o.alias("requirement_id"), F.lit("T").alias("target_id"), F.lit("C").alias("condition_id"),
                      F.lit("true").alias("truth"), F.lit("인용").alias("quote"), F.when(o % 2 == 0, "required").otherwise("not_required").alias("applicability"))
    r = F.col("requirement_id") % 97
    answers = expected.where(r != 0).withColumn("quote", F.when(r == 1, "다른 인용").otherwise(F.col("quote")))
    answers = answers.unionByName(answers.where(r == 2))
    return P.validate_responses(expected, answers).select("contract_id", "requirement_id", "accepted", "applicability")


@query("clause_grounding", "P13", """
SELECT o_orderkey AS record_id, CASE o_orderkey % 8 WHEN 0 THEN 'not_found' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'method_only' ELSE 'matched' END AS match,
  CASE o_orderkey % 8 WHEN 5 THEN 'FAIL' WHEN 6 THEN 'HOLD' WHEN 7 THEN 'PASS' ELSE 'HOLD' END AS status FROM orders""")
def clause_grounding(t):
    k = F.col("record_id") % 8
    text = F.when(k == 4, "검체를 준비한다. 37도에서 둔다.\n- 3 -").otherwise("검체를 준비한다.\n3/21\n균이 검출되지 않아야 한다. 수율은 90% 이상이어야 함.")
    candidates = t.wide("orders", F.col("o_orderkey").alias("record_id")).select("record_id", F.lit(1).alias("candidate_id"), text.alias("text"))

    def answer(i, kind, status):
        return F.struct(F.lit(i).alias("clause_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(status) if isinstance(status, str) else status).alias("status"))
    third = answer(3, "acceptance", F.when(k == 6, "HOLD").when(k == 2, "N/A").otherwise("PASS"))
    full = F.array(answer(1, "procedure", "N/A"), answer(2, F.when(k == 3, "procedure").otherwise("acceptance"), F.when(k == 3, "N/A").when(k == 5, "FAIL").otherwise("PASS")), third)
    methods_only = F.array(answer(1, "procedure", "N/A"), answer(2, "procedure", "N/A"))
    given = F.when(k == 4, methods_only).when(k == 1, F.slice(full, F.lit(1), F.lit(2))).otherwise(full)
    responses = candidates.where(k != 0).select("record_id", "candidate_id", F.explode(given).alias("a")).select("record_id", "candidate_id", "a.*")
    return P.grounded_verdict(candidates, responses)


@query("criterion_source", "P14 U4", """
SELECT o_orderkey AS record_id, CASE o_orderkey % 6 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'sp' WHEN 2 THEN 'unresolved' WHEN 3 THEN 'sp_supplement' ELSE 'permit' END AS chosen_source,
  CASE o_orderkey % 6 WHEN 1 THEN o_custkey || ' mg 이하' WHEN 3 THEN o_custkey || ' mg 이하' WHEN 4 THEN '5 mg 이하' WHEN 5 THEN '5 mg 이하' END AS chosen_criteria FROM orders""")
def criterion_source(t):
    k = F.col("record_id") % 6
    records = t.wide("orders", F.col("o_orderkey").alias("record_id"), F.concat("o_custkey", F.lit(" mg 이하")).alias("criteria"))

    def basis(source, text):
        return F.struct(F.lit(source).alias("source"), F.lit(text).alias("criteria"))
    rows = (F.when(k == 1, F.array(basis("sp", None))).when(k == 2, F.array(basis("permit", "5 mg 이하"), basis("permit", "6 mg 이하")))
            .when(k == 3, F.array(basis("permit", "일반시험법 제 1 법에 따른다"))).when(k == 4, F.array(basis("permit", "5 mg 이하")))
            .when(k == 5, F.array(basis("permit", "5 mg 이하"), basis("permit", "5mg 이하"))))
    bases = records.select("record_id", F.explode(rows).alias("b")).select("record_id", "b.*")
    chosen = P.criterion_source(records, bases, supplement=True)
    return chosen.select("record_id", "chosen_source", F.replace("chosen_criteria", F.lit("5mg"), F.lit("5 mg")).alias("chosen_criteria"))


@query("product_profile", "P15", """
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'NATION_' || c_nationkey WHEN c_nationkey % 7 = 0 THEN 'unknown' ELSE n_name END AS rule_product,
  CASE WHEN c_custkey % 3 = 0 OR c_nationkey % 7 = 0 THEN 'submitted' ELSE 'permit' END AS source FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def product_profile(t):
    docs = t.wide("customer", F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("NATION_"), "c_nationkey")).otherwise("unknown").alias("product"))
    links = t.customer.select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("permit_id"))
    text = F.concat(F.lit("제품명 : "), F.lower("n_name"), F.when(F.col("n_nationkey") % 7 == 0, "\n제품명: 다른것").otherwise(""))
    pages = t.nation.select(F.col("n_nationkey").alias("permit_id"), text.alias("text"))
    return P.product_profile(docs, links, pages, r"제품명\s*:\s*(\S+)", t.nation.select(F.col("n_name").alias("product")))


@query("contract_binding", "P16", """
SELECT o_custkey AS contract_id, NOT BOOL_OR(o_orderkey % 53 IN (0, 1)) AS bound FROM orders GROUP BY o_custkey""")
def contract_binding(t):
    current = t.wide("orders", F.col("o_custkey").alias("contract_id"), F.col("o_orderkey").alias("node"), F.col("o_totalprice").cast("string").alias("text"))
    k = F.col("node") % 53
    reviewed = current.where(k != 0).withColumn("text", F.when(k == 1, "changed").otherwise(F.col("text")))
    return P.same_inventory(reviewed, current, "contract_id")


@query("evidence_selection", "P17", f"""WITH {_SEARCH_SQL},
k AS (SELECT record_id, chunk_no, name_score + stage_score AS score, chunk_no % 3 = 0 AS direct FROM n WHERE NOT (b IN ('확인시험', '성상', '무균시험', '시험') AND stage_score = 0)),
s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY record_id ORDER BY score DESC, chunk_no) AS top FROM k),
d AS (SELECT *, direct AND ROW_NUMBER() OVER (PARTITION BY record_id, direct ORDER BY score DESC, chunk_no) <= 4 AS first FROM s WHERE top <= 12),
e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY record_id ORDER BY first DESC, score DESC, chunk_no) AS rank FROM d)
SELECT record_id, chunk_no, rank, direct FROM e WHERE rank <= 5""")
def evidence_selection(t):
    found = P.permit_search(*_search_sides(t), top_k=12)
    ranked = found.select("record_id", "chunk_no", "score", (F.col("chunk_no") % 3 == 0).alias("direct"), F.lit("본문").alias("text"))
    return P.select_evidence(ranked).select("record_id", "chunk_no", "rank", "direct")


@query("permit_text_requirement", "P18 G17", """
SELECT o_orderkey AS record_id, CASE o_orderkey % 6 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'FAIL' WHEN 3 THEN 'PASS' WHEN 4 THEN 'PASS' END AS status FROM orders""")
def permit_text_requirement(t):
    pairs = [("균이 검출되지 않아야 한다", "불검출"), ("균이 검출되지 않아야 한다", "검출됨"), ("표준품과 일치", "일치하지 않음"), ("표준품과 일치", "일치함"),
             ("밴드가 확인되어야 한다", "확인함"), ("설명", "결과")]
    k = (F.col("record_id") % 6).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(p[i]) for p in pairs]), k)
    return t.wide("orders", F.col("o_orderkey").alias("record_id")).select("record_id", P.text_requirement(pick(0), pick(1)).alias("status"))


@query("review_packet_roles", "P19", f"""WITH {HEADS_SQL}, c AS (SELECT doc_id, line_no, depth FROM h WHERE depth IS NOT NULL),
x AS (SELECT *, LEAD(depth) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt,
  (SELECT MIN(line_no) FROM c b WHERE b.doc_id = c.doc_id AND b.line_no > c.line_no AND b.depth <= c.depth) AS stop FROM c),
y AS (SELECT *, nxt IS NULL OR nxt <= depth AS leaf, line_no % 3 = 0 AS need FROM x),
a AS (SELECT DISTINCT p.doc_id, p.line_no FROM y p JOIN y k ON k.doc_id = p.doc_id AND k.line_no > p.line_no AND (p.stop IS NULL OR k.line_no < p.stop) WHERE k.need),
r AS (SELECT DISTINCT k.doc_id, k.line_no FROM y p JOIN y k ON k.doc_id = p.doc_id AND k.line_no > p.line_no AND (p.stop IS NULL OR k.line_no < p.stop))
SELECT y.doc_id, y.line_no AS node, CASE WHEN need AND leaf THEN 'required_leaf' WHEN need THEN 'not_a_leaf' WHEN a.doc_id IS NOT NULL THEN 'ancestor'
  WHEN r.doc_id IS NULL THEN 'unscoped' ELSE 'elsewhere' END AS role, need AS linked_once
FROM y LEFT JOIN a ON a.doc_id = y.doc_id AND a.line_no = y.line_no LEFT JOIN r ON r.doc_id = y.doc_id AND r.line_no = y.line_no""")
def review_packet_roles(t):
    lines = numbered_lines(t).select("doc_id", "line_no", "block", "heading")
    chunks = L.section_paths(lines, ["doc_id"], "line_no").where("heading is not null").withColumnRenamed("line_no", "position")
    leaves = P.scope_leaves(chunks, "doc_id").select("doc_id", F.col("position").alias("node"), F.lit(True).alias("leaf"))
    above = F.transform(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))), lambda p: p["pos"])
    nodes = chunks.select("doc_id", F.col("position").alias("node"), above.alias("ancestors")).join(leaves, ["doc_id", "node"], "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    return P.node_roles(nodes, nodes.where("node % 3 = 0").select("doc_id", "node"), "doc_id")
