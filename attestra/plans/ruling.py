"""Document rules over orders (documents) and their lines (records)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import judgement as J
from ..operators import outcome as O
from ..operators import rules as R
from ..operators.materials import material_rows
from ..operators.ordered import neighbour, range_blocks
from ..operators.review import record_guards, review, run_rules
from ..operators.rules import Rule
from .judging import JUDGED_SQL
from .records import records
from .registry import query

SHIFT = 7305  # twenty years: source dates are written with years 20xx

OUTCOME_SQL = """
SELECT d.doc_id, CASE WHEN COALESCE(v, 0) > 0 THEN 'FAIL' WHEN COALESCE(m, 0) > 0 THEN 'HOLD'
    WHEN COALESCE(c, 0) = 0 THEN 'HOLD' ELSE 'PASS' END AS status,
  COALESCE(v, 0) AS violations, COALESCE(m, 0) AS missing, COALESCE(c, 0) AS checked
FROM docs d LEFT JOIN (
  SELECT doc_id, COUNT(*) FILTER (status = 'FAIL') AS v, COUNT(*) FILTER (status = 'HOLD') AS m,
    COUNT(*) FILTER (status IN ('PASS', 'FAIL')) AS c FROM checks GROUP BY doc_id) k USING (doc_id)"""
ORDER_DOCS = "docs AS (SELECT o_orderkey AS doc_id FROM orders)"
LINES_SQL = f"""l AS (SELECT l_orderkey AS doc_id, l_linenumber AS f, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q,
  CAST(l_shipdate AS DATE) + {SHIFT} AS shipped FROM lineitem)"""
ORDERS_SQL = f"""o AS (SELECT o_orderkey AS doc_id, o_custkey, CAST(o_orderdate AS DATE) + {SHIFT} AS made,
  o_custkey % 24 + 1 AS months, o_totalprice FROM orders)"""


def order_docs(t):
    return t.orders.select(F.col("o_orderkey").alias("doc_id"))


def dotted(date):
    return F.date_format(date, "yyyy.MM.dd")


def lines(t):
    return t.wide("lineitem", F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("double").alias("order_idx"),
                  F.col("l_linenumber").alias("f"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"),
                  F.date_add(F.to_date("l_shipdate"), SHIFT).alias("shipped"), F.lit("test").alias("record_type"))


def orders(t):
    return t.wide("orders", F.col("o_orderkey").alias("doc_id"), "o_custkey", F.date_add(F.to_date("o_orderdate"), SHIFT).alias("made"),
                  (F.col("o_custkey") % 24 + 1).cast("int").alias("months"), "o_totalprice", F.lit("content").alias("record_type"),
                  F.lit("1. 원액 제조").alias("section_title"), F.lit("").alias("test_name"))


def finish(docs, checks):
    return O.outcome(docs, checks).select("doc_id", "status", "violations", "missing", "checked")


@query("rule_version", "R1 R27", f"""
WITH docs AS (SELECT DISTINCT source AS doc_id FROM documents),
v AS (SELECT source AS doc_id, CASE WHEN CAST(REPLACE(source, 'src', '') AS INT) % 2 = 0 THEN 0 ELSE n_chars % 3 END AS n
  FROM documents WHERE doc_id % 3 <> 0 AND CAST(REPLACE(source, 'src', '') AS INT) % 5 <> 0),
checks AS (SELECT doc_id, CASE WHEN MIN(n) = MAX(n) THEN 'PASS' ELSE 'FAIL' END AS status FROM v GROUP BY doc_id)
{OUTCOME_SQL}""")
def rule_version(t):
    number = F.replace("source", F.lit("src"), F.lit("")).cast("int")
    version = F.concat(F.lit("\nVER. 2."), F.when(number % 2 == 0, F.lit(0)).otherwise(F.col("n_chars") % 3).cast("int"), F.lit(" (2024-05-01)"))
    marked = (F.col("doc_id") % 3 != 0) & (number % 5 != 0)
    pages = t.wide("documents", F.col("source").alias("doc_id"), F.concat("text", F.when(marked, version).otherwise("")).alias("text"))
    return finish(pages.select("doc_id"), R.version_consistency(pages, Rule("A.1", "version_consistency")))


@query("rule_pages", "R2", f"""
WITH docs AS (SELECT DISTINCT conv_id AS doc_id FROM conversations),
n AS (SELECT conv_id, MAX(turn) + 1 AS n, COUNT(*) AS rows, COUNT(DISTINCT turn) AS turns FROM conversations GROUP BY conv_id),
checks AS (SELECT conv_id AS doc_id, CASE WHEN rows = n AND turns = n AND conv_id % 7 <> 0 AND (conv_id % 5 <> 0 OR n < 3)
  THEN 'PASS' ELSE 'FAIL' END AS status FROM n)
{OUTCOME_SQL}""")
def rule_pages(t):
    turns = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn"))
    total = turns.groupBy("doc_id").agg((F.max("turn") + 1).alias("n"))
    # a printed number is wrong in every fifth document, the printed total in every seventh
    k = F.when((F.col("doc_id") % 5 == 0) & (F.col("turn") == 2), F.col("turn")).otherwise(F.col("turn") + 1)
    n = F.when(F.col("doc_id") % 7 == 0, F.col("n") + 1).otherwise(F.col("n"))
    pages = turns.join(total, "doc_id").select("doc_id", F.col("turn").alias("page_no"), F.concat(k, F.lit(" / "), n, F.lit(" 페이지")).alias("text"))
    return finish(turns, R.page_continuity(pages, Rule("A.2", "page_continuity")))


@query("rule_required_tests", "R4", f"""
WITH {ORDER_DOCS}, want AS (SELECT * FROM (VALUES (1), (2), (3)) w(f)),
checks AS (SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = d.doc_id AND l_linenumber = w.f)
  THEN 'PASS' ELSE 'FAIL' END AS status FROM docs d, want w)
{OUTCOME_SQL}""")
def rule_required_tests(t):
    tests = lines(t).select("doc_id", "order_idx", "record_type", F.lit("2. 원액 시험").alias("section_title"),
                            F.concat(F.lit("항목 "), F.col("f"), F.lit(" 확인 시험")).alias("test_name"))
    rule = Rule("A.3", "required_tests", {"context": ["원액"]}, {"tests": ["항목1 확인시험", "항목2", "항목 3 확인"]})
    return finish(order_docs(t), R.required_tests(order_docs(t), tests, rule))


@query("rule_duration", "R7 N6", f"""
WITH {ORDER_DOCS}, {LINES_SQL},
checks AS (SELECT doc_id, CASE WHEN f = 7 THEN 'HOLD' WHEN q + 1 < 14 THEN 'FAIL' ELSE 'PASS' END AS status FROM l)
{OUTCOME_SQL}""")
def rule_duration(t):
    end = F.date_add("shipped", F.col("q"))
    period = (F.when(F.col("f") == 7, F.concat(dotted("shipped"), F.lit(" ~ 미정")))
              .when(F.col("f") % 2 == 0, F.concat(dotted("shipped"), F.lit(" ~ "), F.date_format(end, "yyyy-M-d")))
              .otherwise(F.concat(F.date_format("shipped", "yyyy년 M월 d일"), F.lit("부터 "), F.date_format(end, "yyyy/MM/dd"), F.lit("까지"))))
    tests = lines(t).withColumns({"test_period": period, "section_title": F.lit("무균"), "test_name": F.lit("무균시험")})
    rule = Rule("C.1", "duration", {"type": "test"}, {"minimum_days": 14, "inclusive": True})
    return finish(order_docs(t), R.duration(tests, rule))


@query("rule_elapsed", "R8 N9 N10", """
WITH e AS (SELECT event_id, user_id, DATE_TRUNC('second', ts) AS s, LEAD(DATE_TRUNC('second', ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events),
docs AS (SELECT DISTINCT user_id AS doc_id FROM events),
checks AS (SELECT user_id AS doc_id, CASE WHEN f IS NULL THEN 'HOLD' WHEN event_id % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM e)
""" + OUTCOME_SQL)
def rule_elapsed(t):
    events = range_blocks(t.events.select(F.col("user_id").alias("doc_id"), "event_id", "ts"), ["doc_id"], ["ts", "event_id"], "blk")
    steps = neighbour(events, ["doc_id"], "blk", ["ts", "event_id"], F.col("ts"), "next_ts", following=True)
    begin, finish_ts = (F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("ts", "next_ts"))
    span = F.unix_timestamp(finish_ts) - F.unix_timestamp(begin) + F.when(F.col("event_id") % 3 == 0, 90).otherwise(30)
    stated = F.concat(F.floor(span / 3600), F.lit("시간 "), F.floor(span % 3600 / 60), F.lit("분 "), span % 60, F.lit("초"))
    content = F.concat_ws("\n", F.concat(F.lit("시작일시: "), begin), F.concat(F.lit("종료 일시 : "), finish_ts), F.concat(F.lit("처리시간: "), stated))
    process = steps.select("doc_id", F.col("event_id").cast("double").alias("order_idx"), F.lit("content").alias("record_type"),
                           F.lit("배양").alias("section_title"), F.lit("").alias("test_name"), content.alias("content"))
    rule = Rule("C.2", "elapsed_time", {}, {"start_field": "시작일시", "end_field": "종료일시", "duration_field": "처리시간", "tolerance_seconds": 60})
    return finish(events, R.elapsed_time(process, rule))


@query("rule_expiry", "R9 N7 T18", f"""
WITH {ORDER_DOCS}, {ORDERS_SQL},
checks AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'HOLD' WHEN doc_id % 13 = 0 THEN 'FAIL' WHEN doc_id % 3 = 2 THEN 'FAIL' ELSE 'PASS' END AS status FROM o)
{OUTCOME_SQL}""")
def rule_expiry(t):
    until = F.when(F.col("doc_id") % 13 == 0, F.date_sub("made", 1)).otherwise(F.date_add(F.add_months("made", F.col("months")), (F.col("doc_id") % 3 - 1).cast("int")))
    term = F.when(F.col("doc_id") % 11 == 0, F.concat(F.col("months"), F.lit("~36개월"))).otherwise(F.concat(F.lit("제조일로부터 "), F.col("months"), F.lit(" 개월")))
    content = F.concat_ws("\n", F.concat(F.lit("제조 년월일: "), dotted("made")), F.concat(F.lit("유효기간 | "), dotted(until)), F.concat(F.lit("사용기간: "), term))
    term_gap = (F.col("doc_id") % 11 == 0) & (F.col("doc_id") % 13 == 0)
    docs = orders(t).withColumn("content", F.when(term_gap, F.lit("사용기간: 12개월")).otherwise(content))
    rule = Rule("C.3", "expiry", {"type": "content"}, {"start_field": "제조년월일", "end_field": "유효기간", "duration_field": "사용기간"})
    return finish(order_docs(t), R.expiry(docs, rule))


@query("rule_signature", "R10", f"""
WITH {ORDER_DOCS}, checks AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 < 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders)
{OUTCOME_SQL}""")
def rule_signature(t):
    n = F.col("doc_id") % 4
    content = F.when(n == 0, "서명: 홍길동").when(n == 1, "서 명 | 김영희 |").when(n == 2, "서명: （ 서명 ）").otherwise("서명:")
    return finish(order_docs(t), R.signature(orders(t).withColumn("content", content), Rule("A.4", "signature")))


@query("rule_sign_order", "R11", f"""
WITH {ORDER_DOCS}, {ORDERS_SQL}, {LINES_SQL},
x AS (SELECT doc_id, MAX(CASE WHEN f <> 6 THEN shipped END) AS latest, BOOL_OR(f = 6) AS gap FROM l GROUP BY doc_id),
checks AS (SELECT COALESCE(o.doc_id, x.doc_id) AS doc_id, CASE WHEN made + CAST(months * 100 AS INT) < latest THEN 'FAIL'
  WHEN COALESCE(gap, TRUE) THEN 'HOLD' ELSE 'PASS' END AS status FROM o FULL JOIN x ON o.doc_id = x.doc_id)
{OUTCOME_SQL}""")
def rule_sign_order(t):
    signed = orders(t).withColumn("content", F.concat(F.lit("확인자: QA\n날짜: "), F.date_format(F.date_add("made", F.col("months") * 100), "yyyy. M. d")))
    tests = lines(t).select("doc_id", "record_type", "order_idx", F.lit("최종 시험").alias("section_title"), F.lit("역가시험").alias("test_name"),
                            F.when(F.col("f") == 6, "2024.13.01").otherwise(dotted("shipped")).alias("test_period"), F.lit("").alias("content"))
    both = signed.select("doc_id", "record_type", F.lit(None).cast("double").alias("order_idx"), F.lit("확인").alias("section_title"), "test_name",
                         F.lit("").alias("test_period"), "content").unionByName(tests)
    rule = Rule("C.4", "signature_order", {"context": ["확인"]}, {"tests": {"context": ["최종시험"]}})
    return finish(order_docs(t), R.signature_order(both, rule))


@query("rule_process_order", "R12", f"""
WITH {ORDER_DOCS}, {LINES_SQL},
n AS (SELECT doc_id, f, CASE WHEN MIN(shipped) = MAX(shipped) THEN MIN(shipped) END AS d FROM l GROUP BY doc_id, f),
checks AS (SELECT a.doc_id, CASE WHEN a.d IS NULL OR b.d IS NULL THEN 'HOLD' WHEN a.d > b.d THEN 'FAIL' ELSE 'PASS' END AS status
  FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.f = a.f + 1)
{OUTCOME_SQL}""")
def rule_process_order(t):
    nodes = lines(t).select("doc_id", F.col("f").alias("node_id"), F.create_map(F.lit("제조년월일"), dotted("shipped")).alias("fields"))
    ids = nodes.select("doc_id", "node_id").distinct()
    edges = ids.select("doc_id", F.col("node_id").alias("src")).join(
        ids.select("doc_id", (F.col("node_id") - 1).alias("src"), F.col("node_id").alias("dst")), ["doc_id", "src"])
    return finish(order_docs(t), R.process_order(nodes, edges, Rule("C.5", "process_order")))


def _storage_records(t):
    sources = orders(t).select(
        "doc_id", "record_type", F.lit(0.0).alias("order_idx"), "section_title", "test_name",
        F.concat(F.lit("제조년월일: "), dotted("made"), F.lit("\n허가된 저장기간: "), F.col("months"), F.lit("개월")).alias("content"), F.lit("").alias("test_period"))
    tests = lines(t).select("doc_id", "record_type", "order_idx", F.lit("완제 시험").alias("section_title"), F.lit("역가시험").alias("test_name"),
                            F.when(F.col("f") == 4, F.concat(F.lit("제조년월일: "), dotted("shipped"))).otherwise("").alias("content"),
                            F.when(F.col("f").isin(4, 5, 6), "").otherwise(dotted("shipped")).alias("test_period"), F.when(F.col("f") == 5, dotted("shipped")).alias("test_date"))
    return sources.unionByName(tests, allowMissingColumns=True)


@query("rule_storage_window", "R13", f"""
WITH {ORDER_DOCS}, {ORDERS_SQL}, {LINES_SQL},
checks AS (SELECT l.doc_id, CASE WHEN f = 6 THEN 'HOLD' WHEN shipped > CAST(made + TO_MONTHS(CAST(months AS INT)) AS DATE) THEN 'FAIL' ELSE 'PASS' END AS status
  FROM l JOIN o USING (doc_id))
{OUTCOME_SQL}""")
def rule_storage_window(t):
    rule = Rule("C.6", "storage_window", {"type": "content"}, {"target": {"type": "test"}})
    return finish(order_docs(t), R.storage_window(_storage_records(t), rule))


@query("rule_after_manufacture", "R22", f"""
WITH {ORDER_DOCS}, {ORDERS_SQL}, {LINES_SQL},
checks AS (SELECT l.doc_id, CASE WHEN f IN (4, 6) THEN 'HOLD' WHEN shipped < made THEN 'FAIL' ELSE 'PASS' END AS status FROM l JOIN o USING (doc_id))
{OUTCOME_SQL}""")
def rule_after_manufacture(t):
    rule = Rule("C.7", "test_after_manufacture", {}, {"stages": [{"source": ["원액"], "target": ["완제"]}]})
    return finish(order_docs(t), R.test_after_manufacture(_storage_records(t), rule))


@query("rule_storage_period", "R23", f"""
WITH {ORDER_DOCS}, {ORDERS_SQL},
checks AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'HOLD' WHEN doc_id % 5 = 3 THEN 'FAIL'
  WHEN made + CAST(doc_id % 400 AS INT) > CAST(made + TO_MONTHS(CAST(months AS INT)) AS DATE) THEN 'FAIL' ELSE 'PASS' END AS status FROM o)
{OUTCOME_SQL}""")
def rule_storage_period(t):
    n = F.col("doc_id") % 5
    begin = F.when(n == 3, F.date_add("made", 1)).otherwise(F.col("made"))
    period = F.concat(dotted(begin), F.when(n == 4, F.lit("")).otherwise(F.concat(F.lit(" ~ "), dotted(F.date_add("made", (F.col("doc_id") % 400).cast("int"))))))
    docs = orders(t).withColumn("content", F.concat(F.lit("제조년월일: "), dotted("made"), F.lit("\n저장기간: "), period,
                                                    F.lit("\n허가된 저장기간: "), F.col("months"), F.lit(" 개월")))
    return finish(order_docs(t), R.storage_period(docs, Rule("C.8", "storage_period")))


@query("rule_mass_balance", "R14 B7", f"""
WITH {ORDER_DOCS}, {ORDERS_SQL},
s AS (SELECT l_orderkey AS doc_id, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS total, BOOL_OR(l_linenumber = 7 AND l_suppkey % 2 = 0) AS gap
  FROM lineitem GROUP BY l_orderkey),
checks AS (SELECT o.doc_id, CASE WHEN s.doc_id IS NULL OR gap THEN 'HOLD' WHEN CAST(o_totalprice AS DECIMAL(18,2)) > total THEN 'FAIL' ELSE 'PASS' END AS status
  FROM o LEFT JOIN s USING (doc_id))
{OUTCOME_SQL}""")
def rule_mass_balance(t):
    head = orders(t).select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("line_no"), F.concat(F.lit("제조량: "), F.format_number("o_totalprice", 2), F.lit(" mL")).alias("text")),
        F.struct(F.lit(1).alias("line_no"), F.lit("직접 투입 성분").alias("text")),
        F.struct(F.lit(100).alias("line_no"), F.lit("투입 성분 끝").alias("text")))).alias("r")).select("doc_id", "r.*")
    amount = F.concat(F.format_number("l_extendedprice", 2), F.lit(" mL"))
    body = t.wide("lineitem", F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") + 1).alias("line_no"), F.concat(
        F.lit("원료 | 성분 | L"), F.col("l_partkey"), F.lit(" | "),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_suppkey") % 2 == 0), F.lit("")).otherwise(amount)).alias("text"))
    rule = Rule("B.1", "mass_balance", {}, {"output_field": "제조량", "start_marker": "직접 투입 성분", "end_marker": "투입 성분 끝"})
    return finish(order_docs(t), R.mass_balance(head.unionByName(body), rule))


@query("rule_precision", "R15", f"""
WITH {ORDER_DOCS}, {LINES_SQL},
checks AS (SELECT doc_id, CASE WHEN f = 6 THEN 'HOLD' WHEN f = 5 THEN 'HOLD' WHEN l_suppkey % 3 = 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM l)
{OUTCOME_SQL}""")
def rule_precision(t):
    f, n = F.col("f"), F.col("l_suppkey") % 3
    unit = F.when(f % 2 == 0, " nm").otherwise("%")
    digits = F.when(n == 0, ".25").when(n == 1, ".5").otherwise("")
    criteria = (F.when(f == 5, "1.25% ~ 2.5%").when(f == 4, "10.5 ~ 20.5").otherwise(F.concat(F.lit("10.5"), unit, F.lit(" 이상"))))
    result = (F.when(f == 6, "2.5 EU/mL").when(f == 4, F.concat(F.col("q"), digits)).otherwise(F.concat(F.col("q"), digits, unit)))
    tests = lines(t).withColumns({"criteria": criteria, "result": result})
    return finish(order_docs(t), R.precision(tests, Rule("B.2", "precision", {"type": "test"})))


@query("rule_units", "R21 G18", f"""
WITH {ORDER_DOCS}, {LINES_SQL},
checks AS (SELECT doc_id, CASE WHEN l_suppkey % 4 = 0 THEN 'PASS' WHEN l_suppkey % 4 = 1 THEN 'FAIL' WHEN l_suppkey % 4 = 2 AND f % 2 = 0 THEN 'PASS'
  ELSE 'FAIL' END AS status FROM l WHERE f <> 7)
{OUTCOME_SQL}""")
def rule_units(t):
    n, q = F.col("l_suppkey") % 4, F.col("q")
    result = (F.when(n == 0, F.concat(q, F.lit(" ㎍/㎖"))).when(n == 1, F.concat(q, F.lit(" IU/mL"))).when(n == 2, F.concat(q, F.lit(" pg/uL"))).otherwise(q.cast("string")))
    tests = lines(t).withColumns({
        "criteria": F.when(F.col("f") == 7, "이상 없음").otherwise(F.concat(F.col("l_partkey") % 50, F.lit(" μg/mL 이하"))),
        "result": R.sub(F.replace(F.replace(result, F.lit("㎍"), F.lit("μg")), F.lit("㎖"), F.lit("mL")), r"\s+", " "),
        "test_name": F.when(F.col("f") % 2 == 0, "단백질 정량").otherwise("함량시험")})
    rule = Rule("B.3", "unit_consistency", {"type": "test"}, {"unit_aliases": [{"test": "단백질", "from": "pg/uL", "to": "ug/mL"}]})
    return finish(order_docs(t), R.unit_consistency(tests, rule))


@query("rule_permit_field", "R16", """
WITH docs AS (SELECT c_custkey AS doc_id FROM customer),
checks AS (SELECT c_custkey AS doc_id, CASE WHEN c_nationkey % 6 = 0 OR c_custkey % 9 = 0 THEN 'HOLD' WHEN c_custkey % 4 = 0 THEN 'FAIL' ELSE 'PASS' END AS status
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
""" + OUTCOME_SQL)
def rule_permit_field(t):
    permits = t.nation.select(F.col("n_nationkey").alias("permit_id"), F.explode(F.array(
        F.concat(F.lit("1. 개요\n제조국명: "), F.col("n_name"), F.lit(" 끝")),
        F.when(F.col("n_nationkey") % 6 == 0, F.concat(F.lit("제조국명: "), F.lower("n_name"), F.lit("X 끝"))).otherwise(F.lit("표지")))).alias("text"))
    named = t.wide("customer", "c_custkey", "c_nationkey").join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    value = F.when(F.col("c_custkey") % 9 == 0, F.lit("")).when(F.col("c_custkey") % 4 == 0, F.concat("n_name", F.lit("9"))).otherwise(F.lower("n_name"))
    docs = named.select(F.col("c_custkey").alias("doc_id"), F.lit("content").alias("record_type"), F.lit("").alias("section_title"), F.lit("").alias("test_name"),
                        F.concat(F.lit("제조국: "), value).alias("content"))
    links = t.customer.select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("permit_id"))
    rule = Rule("A.5", "permit_field", {}, {"sp_field": "제조국", "permit_pattern": r"제조국명:\s*(\S+)\s*끝"})
    return finish(docs, R.permit_field(docs, permits, links, rule))


@query("rule_semantic", "R18 U2", f"""
WITH {ORDER_DOCS}, {LINES_SQL},
n AS (SELECT doc_id, COUNT(*) AS n FROM l GROUP BY doc_id),
checks AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'HOLD' WHEN doc_id % 5 = 1 AND n < 3 THEN 'HOLD' WHEN doc_id % 5 = 4 THEN 'HOLD'
  WHEN doc_id % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM n)
{OUTCOME_SQL}""")
def rule_semantic(t):
    evidence = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.lit("근거 문장").alias("quote"))
    n = F.col("doc_id") % 5
    decisions = order_docs(t).where(n != 0).select(
        "doc_id", F.when(n == 4, "MAYBE").when(F.col("doc_id") % 2 == 0, "PASS").otherwise("FAIL").alias("status"),
        F.when(n == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0))).alias("evidence_indices"))
    # a second rule with its own evidence and the opposite decisions must not touch the first
    other = decisions.select("doc_id", F.when(F.col("status") == "PASS", "FAIL").otherwise("PASS").alias("status"), F.array(F.lit(0)).alias("evidence_indices"))
    mine, theirs = F.lit("D.1").alias("rule_id"), F.lit("D.2").alias("rule_id")
    evidence = evidence.select("*", mine).unionByName(evidence.select("*", theirs))
    decisions = decisions.select("*", mine).unionByName(other.select("*", theirs))
    return finish(order_docs(t), R.semantic_review(evidence, decisions, Rule("D.1", "semantic_review")))


@query("rule_numeric", "R19", f"""
WITH {ORDER_DOCS}, {JUDGED_SQL},
checks AS (SELECT l_orderkey AS doc_id, CASE WHEN n = 3 AND l_linenumber IN (1,2,3,4,5) THEN 'HOLD' ELSE COALESCE(numeric_status, 'HOLD') END AS status FROM judged)
{OUTCOME_SQL}""")
def rule_numeric(t):
    tests = records(t).withColumns({"doc_id": F.col("l_orderkey"), "order_idx": F.col("l_linenumber"), "record_type": F.lit("test")})
    return finish(order_docs(t), R.numeric_compare(tests, Rule("B.4", "numeric_compare")))


@query("rule_duplicates", "R24", f"""
WITH {ORDER_DOCS}, g AS (SELECT l_orderkey AS doc_id, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey % 3),
checks AS (SELECT doc_id, CASE WHEN n > 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM g)
{OUTCOME_SQL}""")
def rule_duplicates(t):
    name = F.concat(F.when(F.col("l_partkey") % 2 == 0, "항 목 ").otherwise("항목"), F.col("f"))
    tests = lines(t).withColumns({"test_name": name, "section_title": F.lit("완제"), "criteria": F.lit("10 mg 이하"),
                                  "result": F.concat(F.col("l_suppkey") % 3, F.when(F.col("q") % 2 == 0, " ㎎").otherwise("MG"))})
    return finish(order_docs(t), R.duplicate_tests(tests, Rule("A.6", "duplicate_tests")))


@query("rule_diagram", "R3", f"""
WITH {ORDER_DOCS}, {ORDERS_SQL},
checks AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'HOLD' WHEN doc_id % 6 = 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM o WHERE doc_id % 6 <> 5)
{OUTCOME_SQL}""")
def rule_diagram(t):
    n = F.col("doc_id") % 6
    nodes = orders(t).select("doc_id", F.lit("n1").alias("node_id"), F.lit("원액  제조").alias("name"),
                             F.when(n != 5, F.create_map(F.lit("제조량"), F.concat(F.col("months"), F.lit(" L")))).alias("fields"))
    body = orders(t).select("doc_id", F.lit("2.1 원액 제조 공정").alias("section_title"), F.concat(
        F.when(n == 2, "총 제조량: ").when(n == 0, "수율: ").otherwise("제조량 | "), F.when(n == 1, F.col("months") + 1).otherwise(F.col("months")), F.lit("L")).alias("content"))
    return finish(order_docs(t), R.diagram_consistency(nodes, body, Rule("A.7", "diagram_consistency", {}, {"field": "제조량"})))


_FINDINGS_SQL = f"""{ORDERS_SQL}, {LINES_SQL},
checks AS (
  SELECT doc_id, 'C.1' AS rule_id, CASE WHEN f = 7 THEN 'HOLD' WHEN q + 1 < 14 THEN 'FAIL' ELSE 'PASS' END AS status FROM l
  UNION ALL SELECT doc_id, 'A.4', CASE WHEN doc_id % 4 < 2 THEN 'PASS' ELSE 'FAIL' END FROM o
  UNION ALL SELECT doc_id, 'A.8', CASE WHEN doc_id % 6 < 3 THEN 'HOLD' ELSE 'PASS' END FROM o),
grid AS (SELECT o.doc_id, r.rule_id, r.product IS NULL OR r.product = 'P' || (o_custkey % 3) AS applies
  FROM o, (VALUES ('A.4', NULL), ('A.8', NULL), ('C.1', 'P1')) r(rule_id, product)),
rolled AS (SELECT doc_id, rule_id, COUNT(*) FILTER (status = 'FAIL') AS v, COUNT(*) FILTER (status = 'HOLD') AS m,
  COUNT(*) FILTER (status IN ('PASS', 'FAIL')) AS c FROM checks GROUP BY ALL),
findings AS (SELECT g.doc_id, g.rule_id, CASE WHEN NOT applies THEN 'N/A' WHEN COALESCE(v, 0) > 0 THEN 'FAIL' WHEN COALESCE(m, 0) > 0 THEN 'HOLD'
  WHEN COALESCE(c, 0) = 0 THEN 'HOLD' ELSE 'PASS' END AS status FROM grid g LEFT JOIN rolled USING (doc_id, rule_id))"""

_RULES = [Rule("A.4", "signature"), Rule("A.8", "diagram_consistency", depends_on={"A.4": "원액"}), Rule("C.1", "duration", products=("P1",))]


def _checks(t):
    short = F.when(F.col("f") == 7, "HOLD").when(F.col("q") + 1 < 14, "FAIL").otherwise("PASS")
    n = F.col("doc_id")
    per_line = lines(t).select("doc_id", "order_idx", short.alias("status"), F.lit("C.1").alias("rule_id"))
    per_doc = orders(t).select("doc_id", F.lit(None).cast("double").alias("order_idx"), F.explode(F.array(
        F.struct(F.when(n % 4 < 2, "PASS").otherwise("FAIL").alias("status"), F.lit("A.4").alias("rule_id")),
        F.struct(F.when(n % 6 < 3, "HOLD").otherwise("PASS").alias("status"), F.lit("A.8").alias("rule_id")))).alias("r")).select("doc_id", "order_idx", "r.*")
    return per_line.unionByName(per_doc)


def _findings(t):
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("  p "), F.col("o_custkey") % 3).alias("product"))
    return O.findings(docs, _checks(t), _RULES)


@query("rule_outcome", "R27 R31 F2 U1", f"""WITH {_FINDINGS_SQL}
SELECT doc_id, rule_id AS test_name, status, CASE LEFT(rule_id, 1) WHEN 'C' THEN 'time' ELSE 'structure' END AS category
FROM findings WHERE status <> 'N/A'""")
def rule_outcome(t):
    rules = [Rule(r.id, r.operation, params={"alias": r.id}) for r in _RULES]
    return O.finding_rows(_findings(t), rules)


@query("rule_dependencies", "R29", f"""WITH {_FINDINGS_SQL}
SELECT f.doc_id, f.rule_id, f.status, CASE WHEN p.doc_id IS NOT NULL THEN 'A.4' END AS blocked_by
FROM findings f LEFT JOIN findings p ON f.doc_id = p.doc_id AND f.rule_id = 'A.8' AND f.status = 'HOLD' AND f.doc_id % 5 <> 0 AND p.rule_id = 'A.4' AND p.status = 'FAIL'""")
def rule_dependencies(t):
    # the scope of the dependency is named by the gap of four documents in five
    checks = _checks(t).withColumn("reason", F.when(F.col("doc_id") % 5 == 0, "정제 제조 누락").otherwise("원 액 제조 누락"))
    marked = O.blocked_by(_findings(t), checks, _RULES)
    return marked.select("doc_id", "rule_id", "status", F.array_join("blocked_by", ",").alias("blocked_by"))


@query("rule_guards", "R28 R30", f"""WITH {LINES_SQL},
g AS (SELECT doc_id, f, MAX(CASE WHEN f = 7 THEN 2 WHEN q + 1 < 14 THEN 3 END) AS guard FROM l GROUP BY doc_id, f),
e AS (SELECT doc_id, f, CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS before FROM l)
SELECT e.doc_id, e.f AS order_idx, CASE before WHEN 3 THEN 'FAIL' WHEN 2 THEN 'HOLD' ELSE 'PASS' END AS previous,
  CASE GREATEST(before, COALESCE(guard, 0)) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'HOLD' ELSE 'PASS' END AS status,
  COALESCE(guard, 0) > before AS changed
FROM e LEFT JOIN g USING (doc_id, f)""")
def rule_guards(t):
    n = F.col("l_suppkey") % 3
    evaluations = lines(t).select("doc_id", "order_idx", F.when(n == 0, "PASS").when(n == 1, "HOLD").otherwise("FAIL").alias("status"))
    lowered = O.apply_guards(evaluations, record_guards(_checks(t), _RULES))
    return lowered.select("doc_id", F.col("order_idx").cast("int").alias("order_idx"), "previous", "status", "changed")


@query("stage_cards", "R32", f"""WITH {LINES_SQL},
c AS (SELECT doc_id, 'S' || (l_suppkey % 5) AS stage, CASE WHEN f = 7 THEN 2 WHEN q + 1 < 14 THEN 3 ELSE 1 END AS s FROM l),
n AS (SELECT doc_id, 'S' || (l_partkey % 4) AS stage, MIN(f) AS position FROM l GROUP BY ALL)
SELECT c.doc_id, c.stage, CASE MAX(s) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'HOLD' ELSE 'PASS' END AS status, COUNT(*) AS checks,
  ANY_VALUE(position) AS position, ANY_VALUE(position) IS NOT NULL AS resolved
FROM c LEFT JOIN n ON c.doc_id = n.doc_id AND c.stage = n.stage GROUP BY c.doc_id, c.stage""")
def stage_cards(t):
    base = lines(t)
    status = F.when(F.col("f") == 7, "HOLD").when(F.col("q") + 1 < 14, "FAIL").otherwise("PASS")
    checks = base.select("doc_id", F.concat(F.lit("S"), F.col("l_suppkey") % 5).alias("stage"), status.alias("status"))
    nodes = base.select("doc_id", F.concat(F.lit("S"), F.col("l_partkey") % 4).alias("stage"), F.col("f").alias("position"))
    return O.stage_cards(checks, nodes)


@query("date_summary", "R33", f"""WITH {_FINDINGS_SQL},
w AS (SELECT doc_id, MAX(CASE status WHEN 'FAIL' THEN 3 WHEN 'HOLD' THEN 2 ELSE 1 END) AS s FROM findings
  WHERE rule_id = 'C.1' AND status <> 'N/A' GROUP BY doc_id)
SELECT o.doc_id, CASE WHEN o.doc_id % 7 = 0 OR s IS NULL THEN 'HOLD' WHEN s = 3 THEN 'FAIL' WHEN s = 2 THEN 'HOLD' ELSE 'PASS' END AS status
FROM o LEFT JOIN w USING (doc_id)""")
def date_summary(t):
    dated = _findings(t).where("rule_id = 'C.1'")
    return O.date_summary(order_docs(t), dated, F.col("doc_id") % 7 != 0).select("doc_id", "status")


@query("shared_evidence", "A18", f"""WITH {_FINDINGS_SQL},
bad AS (SELECT c.doc_id, c.rule_id FROM checks c WHERE status = 'FAIL' AND rule_id <> 'C.1'
  UNION ALL SELECT doc_id, 'C.1' FROM l WHERE f <> 7 AND q + 1 < 14)
SELECT 'doc' || (doc_id % 500) AS file, doc_id % 3 AS page, STRING_AGG(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules
FROM bad GROUP BY ALL HAVING COUNT(DISTINCT rule_id) >= 2""")
def shared_evidence(t):
    bad = _checks(t).where("status = 'FAIL'")
    evidence = bad.select("rule_id", F.concat(F.lit("doc"), F.col("doc_id") % 500).alias("file"), (F.col("doc_id") % 3).alias("page"), F.lit("q").alias("quote"))
    return O.shared_evidence(evidence).select("file", "page", F.array_join("rules", ",").alias("rules"))


@query("lot_worst_of", "G15", f"""WITH {JUDGED_SQL}
SELECT l_orderkey AS doc_id, l_linenumber AS order_idx, CASE MAX(CASE COALESCE(numeric_status, 'HOLD') WHEN 'FAIL' THEN 3 WHEN 'HOLD' THEN 2 ELSE 1 END)
  WHEN 3 THEN 'FAIL' WHEN 2 THEN 'HOLD' ELSE 'PASS' END AS status, COUNT(*) AS rows FROM judged GROUP BY ALL""")
def lot_worst_of(t):
    judged = J.judge(records(t))
    rows = judged.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("order_idx"), "verdict.status")
    return J.worst_of(rows, ["doc_id", "order_idx"])


_REVIEW_RULES = [
    Rule("A.4", "signature", {"type": "content"}, {"alias": "A"}),
    Rule("B.4", "numeric_compare", {"type": "test"}, {"alias": "B"}),
    Rule("C.1", "duration", {"type": "test"}, {"minimum_days": 14, "inclusive": True, "alias": "C"}),
    Rule("C.7", "test_after_manufacture", {}, {"stages": [{"source": ["원액"], "target": ["완제"]}], "alias": "C"}, products=("P1", "P2")),
    # this rule lacks its parameters: it must hold everywhere without stopping the others
    Rule("C.9", "elapsed_time", {}, {"alias": "C"}),
]
_REVIEW_SQL = f"""{JUDGED_SQL}, {ORDERS_SQL},
l AS (SELECT j.*, l_orderkey AS doc_id, l_linenumber AS f, CAST(l_shipdate AS DATE) + {SHIFT} AS shipped, COALESCE(numeric_status, 'HOLD') AS base FROM judged j),
checks AS (SELECT doc_id, 'A.4' AS rule_id, CASE WHEN doc_id % 4 < 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM o
  UNION ALL SELECT doc_id, 'B.4', CASE WHEN n = 3 AND f < 6 THEN 'HOLD' ELSE base END FROM l
  UNION ALL SELECT doc_id, 'C.1', CASE WHEN f = 7 THEN 'HOLD' WHEN q + 1 < 14 THEN 'FAIL' ELSE 'PASS' END FROM l
  UNION ALL SELECT l.doc_id, 'C.7', CASE WHEN f = 7 THEN 'HOLD' WHEN shipped < made THEN 'FAIL' ELSE 'PASS' END FROM l JOIN o ON o.doc_id = l.doc_id),
grid AS (SELECT doc_id, rule_id, rule_id <> 'C.7' OR o_custkey % 3 <> 0 AS applies FROM o, (VALUES ('A.4'), ('B.4'), ('C.1'), ('C.7'), ('C.9')) r(rule_id)),
rolled AS (SELECT doc_id, rule_id, COUNT(*) FILTER (status = 'FAIL') AS v, COUNT(*) FILTER (status = 'HOLD') AS m, COUNT(*) AS c FROM checks GROUP BY ALL),
findings AS (SELECT g.doc_id, g.rule_id, CASE WHEN NOT applies THEN 'N/A' WHEN COALESCE(v, 0) > 0 THEN 'FAIL' WHEN COALESCE(m, 0) > 0 OR c IS NULL THEN 'HOLD' ELSE 'PASS' END AS status,
  g.rule_id = 'C.9' AS execution_error FROM grid g LEFT JOIN rolled r ON r.doc_id = g.doc_id AND r.rule_id = g.rule_id)"""


def _review_inputs(t):
    base = records(t)
    shipped = F.date_add(F.to_date("l_shipdate"), SHIFT)
    period = F.when(F.col("l_linenumber") == 7, "미정").otherwise(F.concat(dotted(shipped), F.lit(" ~ "), dotted(F.date_add(shipped, F.col("q").cast("int")))))
    blank = F.lit("")
    tests = base.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("double").alias("order_idx"), F.lit("test").alias("record_type"),
                        F.lit("완제 시험").alias("section_title"), F.lit("함량").alias("test_name"), blank.alias("method"), "criteria", "result", period.alias("test_period"), blank.alias("content"))
    signed = F.when(F.col("doc_id") % 4 < 2, "서명: 홍길동").otherwise("서명:")
    content = orders(t).select("doc_id", F.lit(0.0).alias("order_idx"), "record_type", "section_title", "test_name", blank.alias("method"), blank.alias("criteria"), blank.alias("result"),
                               blank.alias("test_period"), F.concat(F.lit("제조년월일: "), dotted("made"), F.lit("\n"), signed).alias("content"))
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("P"), F.col("o_custkey") % 3).alias("product"))
    return docs, {"records": tests.unionByName(content)}


@query("rule_run", "R34 R27 U1", f"WITH {_REVIEW_SQL} SELECT doc_id, rule_id, status, execution_error FROM findings")
def rule_run(t):
    docs, inputs = _review_inputs(t)
    return run_rules(docs, inputs, _REVIEW_RULES)[1].select("doc_id", "rule_id", "status", "execution_error")


@query("review_counts", "A1 G19 R28 R30 R31", f"""WITH {_REVIEW_SQL},
g AS (SELECT doc_id, f, MAX(CASE WHEN base = 'FAIL' AND NOT (n = 3 AND f < 6) THEN 3 WHEN f <> 7 AND q + 1 < 14 THEN 3 WHEN f = 7 THEN 2 ELSE 0 END) AS guard FROM l GROUP BY ALL),
e AS (SELECT l.doc_id, CASE GREATEST(CASE base WHEN 'FAIL' THEN 3 WHEN 'HOLD' THEN 2 ELSE 1 END, guard) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'HOLD' ELSE 'PASS' END AS status
  FROM l JOIN g ON g.doc_id = l.doc_id AND g.f = l.f),
u AS (SELECT * FROM e UNION ALL SELECT doc_id, status FROM findings WHERE status <> 'N/A')
SELECT doc_id, COUNT(*) FILTER (status = 'PASS') AS pass, COUNT(*) FILTER (status = 'FAIL') AS fail, COUNT(*) FILTER (status = 'HOLD') AS hold, COUNT(*) AS total
FROM u GROUP BY ROLLUP (doc_id)""")
def review_counts(t):
    docs, inputs = _review_inputs(t)
    return review(docs, inputs, _REVIEW_RULES)["counts"]


# Parameters with which every operation can run over the tables below.
_BOOK = {
    "diagram_consistency": {"field": "제조량"}, "required_tests": {"tests": ["역가시험"]}, "duration": {"minimum_days": 14},
    "elapsed_time": {"start_field": "시작일시", "end_field": "종료일시", "duration_field": "처리시간"},
    "expiry": {"start_field": "제조년월일", "end_field": "유효기한", "duration_field": "허가된 저장기간"}, "signature_order": {"tests": {"type": "test"}},
    "storage_window": {"target": {"type": "test"}}, "mass_balance": {"start_marker": "시작", "end_marker": "끝", "output_field": "제조량"},
    "permit_field": {"permit_pattern": "저장방법: (.*)", "sp_field": "저장방법"}, "permit_test": {"permit_pattern": r"(\d+)", "sp_pattern": r"(\d+)", "sp_attribute": "criteria"},
    "labelled_numeric_compare": {"expected_labels": ["가"]}, "test_after_manufacture": {"stages": [{"source": ["원액"], "target": ["완제"]}]},
    "lot_consistency": {"fields": ["제조량"]}}


@query("rule_book", "R5 R6 R25 R34 U1", f"""
WITH o AS (SELECT o_orderkey AS doc_id, o_custkey FROM orders), n AS (SELECT COUNT(*) AS docs FROM o),
l AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem),
known AS (
  SELECT 'lot_consistency' AS rule_id, COUNT(*) FILTER (o_custkey % 3 <> 0) AS passed, COUNT(*) FILTER (o_custkey % 3 = 0) AS failed FROM o
  UNION ALL SELECT 'permit_required_tests', COUNT(*) FILTER (o_custkey % 4 <> 0), COUNT(*) FILTER (o_custkey % 4 = 0) FROM o
  UNION ALL SELECT 'permit_conditional_tests', COUNT(*) FILTER (o_custkey % 4 <> 0), 0 FROM o
  UNION ALL SELECT 'required_tests', (SELECT COUNT(*) FROM l SEMI JOIN o USING (doc_id)), (SELECT COUNT(*) FROM o ANTI JOIN l USING (doc_id)))
SELECT rule_id, docs, 0 AS errors, passed, failed FROM (VALUES {", ".join(f"('{name}')" for name in R.OPERATIONS)}) r(rule_id) CROSS JOIN n LEFT JOIN known USING (rule_id)""")
def rule_book(t):
    """Every operation in one rule set: none may end as an execution error; four have their outcome checked too."""
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("product"))
    of, none = order_docs(t), F.lit(None).cast("string")
    records = _storage_records(t).withColumns({"criteria": F.lit("40 mg 이하"), "result": F.concat(F.col("order_idx").cast("int"), F.lit(" mg")), "parent_test_group": none})
    node = of.select("doc_id", F.lit("n").alias("node_id"), F.lit("원액").alias("name"), F.create_map(F.lit("제조량"), F.lit("5 L")).alias("fields"))
    cust = t.orders.select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    amounts = F.array(*[F.struct(F.lit(lot).alias("lot"), F.lit(name).alias("field"), value.alias("value")) for lot, name, value in (
        ("L-1", "원액 제조량", F.lit("5 L")), ("L 1", "제조량", F.when(F.col("o_custkey") % 3 == 0, "6 L").otherwise("5L")), ("L-1", "수율", F.lit("9")))])
    batch = F.lit("B1").alias("batch")
    inputs = {
        "records": records, "content": records.where("record_type = 'content'"), "nodes": node,
        "pages": of.select("doc_id", F.lit(1).alias("page_no"), F.lit("Ver. 1.0 (a) 1/1 페이지").alias("text")),
        "edges": of.select("doc_id", F.lit("n").alias("src"), F.lit("n").alias("dst")), "lines": of.select("doc_id", F.lit(1).alias("line_no"), F.lit("제조량: 5 kg").alias("text")),
        "permit_pages": of.select(F.col("doc_id").alias("permit_id"), F.lit("저장방법: 냉장").alias("text")), "links": of.select("doc_id", F.col("doc_id").alias("permit_id")),
        "candidates": of.select("doc_id", F.lit(1.0).alias("order_idx"), F.lit("기준 40").alias("text")), "evidence": of.select("doc_id", F.lit("근거").alias("quote")),
        "decisions": of.select("doc_id", F.lit("PASS").alias("status"), F.array(F.lit(0)).alias("evidence_indices")),
        "occurrences": cust.select("doc_id", F.explode(amounts).alias("v")).select("doc_id", "v.*"),
        "required": of.select("doc_id", F.lit("역가").alias("test_key"), batch),
        "bound_tests": cust.where("o_custkey % 4 <> 0").select("doc_id", F.lit("역가").alias("test_key"), batch, F.lit("적합").alias("result")),
        "unbound": of.where("false"), "mentions": of.where("false").select("doc_id", F.lit("").alias("test_key"), F.lit(0).alias("mentions")),
        "gates": cust.select("doc_id", F.lit("역가").alias("test_key"), batch, F.when(F.col("o_custkey") % 4 == 0, "not_required").otherwise("required").alias("applicability"))}
    rules = [Rule(name, name, {"type": "test"} if name == "required_tests" else {}, _BOOK.get(name, {})) for name in R.OPERATIONS]
    found = run_rules(docs, inputs, rules)[1]
    seen = F.col("rule_id").isin("lot_consistency", "permit_required_tests", "permit_conditional_tests", "required_tests")
    return found.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if("execution_error").alias("errors"),
        F.when(F.max(seen), F.count_if(F.col("status") == "PASS")).alias("passed"), F.when(F.max(seen), F.count_if(F.col("status") == "FAIL")).alias("failed"))


@query("rule_faults", "R34 U1", f"""WITH {ORDERS_SQL},
s AS (SELECT doc_id, doc_id % 4 < 2 AS signed FROM o),
r AS (SELECT rule_id, doc_id, CASE WHEN rule_id LIKE 'bad%' THEN 'HOLD' WHEN signed THEN 'PASS' ELSE 'FAIL' END AS status
  FROM s, (VALUES ('bad_pattern'), ('bad_value'), ('bad_column'), ('good_a'), ('good_b')) v(rule_id))
SELECT rule_id, COUNT(*) FILTER (status = 'PASS') AS pass, COUNT(*) FILTER (status = 'FAIL') AS fail, COUNT(*) FILTER (status = 'HOLD') AS hold,
  COUNT(*) FILTER (rule_id LIKE 'bad%') AS errors FROM r GROUP BY rule_id""")
def rule_faults(t):
    """A pattern that does not compile, a value that overflows while rows are computed and a column that is not there: the other rules answer."""
    docs, inputs = _review_inputs(t)
    content = inputs["records"].where("record_type = 'content'")
    overflow = F.lit(2147483647) + F.col("doc_id").cast("int").bitwiseAND(1) + 1
    nodes = docs.select("doc_id", F.lit("n").alias("node_id"), F.lit("원액").alias("name"), F.create_map(F.lit("제조량"), overflow.cast("string")).alias("fields"))
    pages = docs.select("doc_id", F.lit(1).alias("page_no"), F.lit("Ver. 1.0 (a)").alias("text"))
    rules = [Rule("good_a", "signature", {"type": "content"}), Rule("bad_pattern", "version_consistency", {}, {"pattern": "(["}), Rule("bad_value", "diagram_consistency", {}, {"field": "제조량"}),
             Rule("bad_column", "process_order"), Rule("good_b", "signature", {"type": "content"})]
    found = run_rules(docs, {"records": content, "content": content, "pages": pages, "nodes": nodes, "edges": docs}, rules)[1]
    one = lambda status: F.count_if(F.col("status") == status)
    return found.groupBy("rule_id").agg(one("PASS").alias("pass"), one("FAIL").alias("fail"), one("HOLD").alias("hold"), F.count_if("execution_error").alias("errors"))


# One row of a material table per line item; its lot is cut into up to four lines, which cross a block of line numbers.
_PARTS_SQL = """m AS (SELECT l_orderkey AS doc_id,
  4078 + 4 * ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_no, l_suppkey % 4 AS k, l_partkey % 50 = 1 AS apart, l_partkey,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ' mL' AS amount, CAST(l_extendedprice AS DECIMAL(18,2)) AS n FROM lineitem)"""


def _material_lines(t):
    price, k = F.concat(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit(" mL")), F.col("l_suppkey") % 4
    framed = F.col("l_orderkey") % 2 == 0
    dash = F.when((k > 0) & (F.col("l_partkey") % 50 != 1), "-").otherwise("")
    top = F.concat(F.lit("원료 | 성분 | L"), "l_partkey", dash, F.lit(" | "), price)
    more = lambda j: F.concat(F.lit(f" | 이어 | C{j}"), F.when(k > j, "-").otherwise(""), F.lit(" |"))
    texts = F.concat(F.array(top), F.transform(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")),
                                               lambda j: F.when(j == 1, more(1)).when(j == 2, more(2)).otherwise(more(3))))
    placed = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    body = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").withColumn("place", F.row_number().over(placed)).select(
        F.col("l_orderkey").alias("doc_id"), "place", F.posexplode(texts).alias("j", "line"), framed.alias("framed"))
    body = body.select("doc_id", (4078 + F.col("place") * 4 + F.col("j")).alias("line_no"), F.when(F.col("framed"), F.concat(F.lit("| "), F.ltrim("line"), F.lit(" |"))).otherwise(F.col("line")).alias("text"))
    bar = lambda text: F.when(F.col("doc_id") % 2 == 0, f"| {text} |").otherwise(text)
    head = orders(t).select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("line_no"), F.lit("제조량: 150000.00 mL").alias("text")), F.struct(F.lit(1).alias("line_no"), F.lit("직접 투입 성분").alias("text")),
        F.struct(F.lit(2).alias("line_no"), bar("원료명 | 성분명 | 제조번호 | 분량").alias("text")), F.struct(F.lit(3).alias("line_no"), F.lit("|---|---|---|---|").alias("text")),
        F.struct(F.lit(9000).alias("line_no"), F.lit("투입 성분 끝").alias("text")))).alias("r")).select("doc_id", "r.*")
    return head, body


@query("material_rows", "B7", f"""WITH {_PARTS_SQL}
SELECT doc_id, line_no, '성분' || CASE WHEN apart THEN '' ELSE repeat(' 이어', k) END AS component,
  'L' || l_partkey || CASE WHEN apart OR k = 0 THEN '' WHEN k = 1 THEN '-C1' WHEN k = 2 THEN '-C1-C2' ELSE '-C1-C2-C3' END AS lot, amount FROM m
UNION ALL SELECT doc_id, line_no + j, '이어', 'C' || j || CASE WHEN j < k THEN '-' ELSE '' END, '' FROM m, range(1, 4) r(j) WHERE apart AND j <= k""")
def material_rows_query(t):
    head, body = _material_lines(t)
    rows = material_rows(head.where("line_no in (2, 3)").unionByName(body), ["doc_id"])
    cell = lambda k: F.get("cells", F.lit(k))
    return rows.select("doc_id", "line_no", cell(1).alias("component"), cell(2).alias("lot"), cell(3).alias("amount"))


@query("material_balance", "R14 B7", f"""WITH {_PARTS_SQL}, {ORDER_DOCS},
s AS (SELECT doc_id, SUM(n) AS total, BOOL_OR(apart AND k > 0) AS gap FROM m GROUP BY doc_id),
checks AS (SELECT o.doc_id, CASE WHEN s.doc_id IS NULL OR gap THEN 'HOLD' WHEN 150000.00 > total THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT o_orderkey AS doc_id FROM orders) o LEFT JOIN s USING (doc_id))
{OUTCOME_SQL}""")
def material_balance(t):
    head, body = _material_lines(t)
    rule = Rule("B.1", "mass_balance", {}, {"output_field": "제조량", "start_marker": "직접 투입 성분", "end_marker": "투입 성분 끝"})
    return finish(order_docs(t), R.mass_balance(head.unionByName(body), rule))
