"""Counts, comparisons of runs, gold comparison, corpus reports and the inbox."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.codes import fingerprint
from ..operators import inbox as I
from ..operators import judgement as J
from ..operators import reports as P
from ..session import cut_lineage, shared_folder
from ..sources import readers as S
from ..sources import rulesets, writers
from .judging import JUDGED_SQL
from .records import records
from .registry import query
from .ruling import order_docs
from .texts import SPLIT_SQL, doc_lines

_STATUS_SQL = "CASE WHEN l_quantity > 40 THEN 'FAIL' WHEN l_quantity > 35 THEN 'HOLD' ELSE 'PASS' END"
_COUNT_SQL = "COUNT(*) FILTER (status = 'PASS') AS pass, COUNT(*) FILTER (status = 'FAIL') AS fail, COUNT(*) FILTER (status = 'HOLD') AS hold, COUNT(*) AS total"


def status(column="l_quantity"):
    return F.when(F.col(column) > 40, "FAIL").when(F.col(column) > 35, "HOLD").otherwise("PASS")


@query("record_or_lot_counts", "A1", f"""
WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS order_idx, {_STATUS_SQL} AS status, l_suppkey % 3 = 0 AS lot FROM lineitem),
e AS (SELECT doc_id, order_idx, status FROM l WHERE NOT lot), lots AS (SELECT doc_id, order_idx, status FROM l WHERE lot),
u AS (SELECT doc_id, status FROM lots UNION ALL SELECT doc_id, status FROM e WHERE NOT EXISTS (SELECT 1 FROM lots WHERE lots.doc_id = e.doc_id AND lots.order_idx = e.order_idx))
SELECT doc_id, {_COUNT_SQL} FROM u GROUP BY ROLLUP (doc_id)""")
def record_or_lot_counts(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("order_idx"), status().alias("status"), (F.col("l_suppkey") % 3 == 0).alias("lot"))
    return J.record_or_lot_counts(rows.where("not lot").drop("lot"), rows.where("lot").drop("lot"))


@query("remainder_bucket", "A4", f"""
WITH l AS (SELECT l_orderkey AS doc, {_STATUS_SQL} AS status, l_linenumber <= 3 AS staged FROM lineitem),
t AS (SELECT doc, {_COUNT_SQL} FROM l GROUP BY doc), s AS (SELECT doc, {_COUNT_SQL} FROM l WHERE staged GROUP BY doc)
SELECT doc, t.pass - COALESCE(s.pass, 0) AS pass, t.fail - COALESCE(s.fail, 0) AS fail, t.hold - COALESCE(s.hold, 0) AS hold, t.total - COALESCE(s.total, 0) AS total, TRUE AS consistent
FROM t LEFT JOIN s USING (doc)""")
def remainder_bucket(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), "l_linenumber", status().alias("status"))
    totals = rows.groupBy("doc").agg(*P._counts())
    stages = rows.where("l_linenumber <= 3").groupBy("doc", "l_linenumber").agg(*P._counts())
    return J.remainder(totals, stages, "doc")


@query("before_after", "A5", f"""WITH {JUDGED_SQL},
b AS (SELECT l_suppkey AS stage, COALESCE(numeric_status, 'HOLD') AS status FROM judged WHERE l_suppkey % 10 <> 3),
a AS (SELECT l_suppkey AS stage, CASE WHEN numeric_status IS NULL AND l_orderkey % 2 = 0 THEN 'PASS' ELSE COALESCE(numeric_status, 'HOLD') END AS status FROM judged WHERE l_suppkey % 10 <> 4),
bc AS (SELECT stage, {_COUNT_SQL} FROM b GROUP BY stage), ac AS (SELECT stage, {_COUNT_SQL} FROM a GROUP BY stage)
SELECT COALESCE(ac.stage, bc.stage) AS stage, COALESCE(ac.pass, 0) - COALESCE(bc.pass, 0) AS d_pass, COALESCE(ac.fail, 0) - COALESCE(bc.fail, 0) AS d_fail,
  COALESCE(ac.hold, 0) - COALESCE(bc.hold, 0) AS d_hold, COALESCE(ac.total, 0) - COALESCE(bc.total, 0) AS d_total FROM bc FULL JOIN ac ON ac.stage = bc.stage""")
def before_after(t):
    judged = J.judge(records(t))
    # one pass over the records; both summaries come from the same small counts
    tally = cut_lineage(judged.groupBy(F.col("l_suppkey").alias("stage"), (F.col("l_orderkey") % 2 == 0).alias("linked"), "verdict.status").agg(F.count(F.lit(1)).alias("n")))

    def summary(rows):
        return rows.groupBy("stage").agg(*[F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s.lower()) for s in ("PASS", "FAIL", "HOLD")], F.sum("n").alias("total"))
    after = tally.withColumn("status", F.when((F.col("status") == "HOLD") & F.col("linked"), "PASS").otherwise(F.col("status")))
    return J.before_after(summary(tally.where("stage % 10 <> 3")), summary(after.where("stage % 10 <> 4")), "stage")


@query("stage_counts", "A2", f"""
WITH e AS (SELECT l_orderkey AS doc_id, l_suppkey % 4 AS a, l_partkey % 5 AS n, l_linenumber % 3 AS c, {_STATUS_SQL} AS status FROM lineitem),
s AS (SELECT doc_id, status, CASE WHEN a < 2 THEN a WHEN n IN (1, 2, 3) THEN n - 1 WHEN c < 2 THEN 2 - c END AS k FROM e)
SELECT doc_id, CASE k WHEN 0 THEN '마스터 세포주' WHEN 1 THEN '최종원액' WHEN 2 THEN '완제 의약품' END AS stage, CAST(COUNT(*) FILTER (status = 'PASS') AS BIGINT) AS pass,
  COUNT(*) FILTER (status = 'FAIL') AS fail, COUNT(*) FILTER (status = 'HOLD') AS hold, COUNT(*) AS total FROM s GROUP BY ALL""")
def stage_counts(t):
    a, n, c = F.col("l_suppkey") % 4, F.col("l_partkey") % 5, F.col("l_linenumber") % 3
    title = F.when(a == 0, "1. 마스터세포주 시험").when(a == 1, "최종 원액 시험").otherwise("기타 시험")
    context = F.when(c == 0, "제품 완제의약품 품질").when(c == 1, "앞 최종원액 뒤").otherwise("없음")
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), title.alias("title"), F.concat(n, F.lit(".2")).alias("section_number"), context.alias("context"), status().alias("status"))
    names = F.array(F.lit("마스터 세포주"), F.lit("최종원액"), F.lit("완제 의약품"))
    stages = rows.select("doc_id").distinct().select("doc_id", F.posexplode(names).alias("position", "stage")).withColumn("number", (F.col("position") + 1).cast("string"))
    return P.stage_counts(rows, stages)


@query("stage_list", "A17", """
WITH n AS (SELECT l_orderkey AS doc_id, 'stage' || (l_suppkey % 4) AS k, l_linenumber AS position FROM lineitem WHERE l_orderkey % 2 = 0),
x AS (SELECT l_orderkey, 'title' || (l_suppkey % 3), l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM n)),
u AS (SELECT * FROM n UNION ALL SELECT * FROM x) SELECT doc_id, k AS stage, MIN(position) AS position FROM u GROUP BY ALL""")
def stage_list(t):
    base = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), "l_suppkey")
    nodes = base.where("doc_id % 2 = 0").withColumn("name", F.concat(F.when(F.col("position") % 2 == 0, "Stage ").otherwise("stage"), F.col("l_suppkey") % 4))
    titles = base.withColumn("name", F.concat("position", F.lit(".1 Title "), F.col("l_suppkey") % 3))
    return P.stage_list(nodes, titles).withColumn("stage", F.lower(F.replace("stage", F.lit(" "), F.lit(""))))


@query("rule_observations", "A6", f"""
WITH l AS (SELECT l_orderkey AS doc_id, CASE l_suppkey % 4 WHEN 0 THEN 'lots' WHEN 1 THEN 'dates' ELSE 'other' END AS family, l_suppkey % 4 = 2 AS ref, {_STATUS_SQL} AS status FROM lineitem)
SELECT doc_id, family, {_COUNT_SQL}, BOOL_OR(ref) AS referred FROM l GROUP BY doc_id, family""")
def rule_observations(t):
    source = F.get(F.array(F.lit("제조번호 비교"), F.lit("제조일자 비교"), F.lit("linked permit text"), F.lit("규칙")), (F.col("l_suppkey") % 4).cast("int"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), source.alias("source"), status().alias("status"))
    return P.observations(rows, {"lots": ["제조번호"], "dates": ["제조일자", "제조년월일"]})


@query("gold_compare", "A7", """
WITH o AS (SELECT o_orderkey, o_custkey % 3 AS v1, o_custkey % 2 AS v2 FROM orders)
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'unset' WHEN v1 <> 1 OR (o_orderkey % 4 = 2 AND v2 <> 0) THEN 'mismatch' ELSE 'match' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CONCAT_WS(',', CASE WHEN v1 <> 1 THEN 'lots' END, CASE WHEN o_orderkey % 4 = 2 AND v2 <> 0 THEN 'overall' END) END AS names FROM o""")
def gold_compare(t):
    o = F.col("doc_id")
    base = t.wide("orders", F.col("o_orderkey").alias("doc_id"), "o_custkey")
    observed = base.select("doc_id", F.explode(F.array(
        F.struct(F.lit("lots").alias("name"), (F.col("o_custkey") % 3).cast("string").alias("value")), F.struct(F.lit("overall").alias("name"), (F.col("o_custkey") % 2).cast("string").alias("value")))).alias("r")).select("doc_id", "r.*")
    gold = base.select("doc_id", F.explode(F.array(
        F.struct(F.lit("lots").alias("name"), F.when(o % 4 == 0, "미설정").otherwise("1").alias("value")),
        F.struct(F.lit("overall").alias("name"), F.when(o % 4 == 2, "0").otherwise(" ").alias("value")))).alias("r")).select("doc_id", "r.*")
    return P.gold_comparison(observed, gold)


@query("run_dedupe", "A8 S9 N14", """
WITH r AS (SELECT o_orderkey, SHA256(CONCAT_WS(CHR(31), CAST(o_custkey AS VARCHAR), o_orderpriority, 'engine-1')) AS run_id FROM orders)
SELECT run_id, COUNT(*) AS requests FROM r WHERE run_id NOT IN (SELECT run_id FROM r WHERE o_orderkey % 10 = 0) GROUP BY run_id""")
def run_dedupe(t):
    runs = P.run_ids(t.wide("orders", "o_orderkey", "o_custkey", "o_orderpriority", F.lit("engine-1").alias("engine")), ["o_custkey", "o_orderpriority", "engine"])
    fresh = P.new_runs(runs, runs.where("o_orderkey % 10 = 0")).select("run_id")
    return runs.join(fresh, "run_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("requests"))


@query("corpus_assess", "A9", """
WITH f AS (SELECT DISTINCT l_orderkey AS doc_id, 'R' || l_linenumber AS rule_id FROM lineitem WHERE l_quantity > 40),
x AS (SELECT o_orderkey AS doc_id, 'R' || (o_custkey % 7 + 1) AS rule_id FROM orders WHERE o_orderkey % 5 = 0)
SELECT *, 'missing' AS kind FROM x WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = x.doc_id AND f.rule_id = x.rule_id)
UNION ALL SELECT *, 'false_positive' FROM f WHERE doc_id % 5 = 1""")
def corpus_assess(t):
    findings = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("R"), "l_linenumber").alias("rule_id"), status().alias("status"))
    expected = t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("R"), F.col("o_custkey") % 7 + 1).alias("rule_id"))
    clean_docs = t.lineitem.select(F.col("l_orderkey").alias("doc_id")).where("doc_id % 5 = 1").distinct()
    return P.corpus_assessment(findings, expected, clean_docs)


@query("run_compare", "A10", f"""
WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS f, {_STATUS_SQL} AS status FROM lineitem WHERE l_orderkey % 89 <> 0),
r AS (SELECT l_orderkey AS doc_id, l_linenumber AS f, CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN 'N/A' ELSE {_STATUS_SQL} END AS status FROM lineitem),
j AS (SELECT COALESCE(a.doc_id, b.doc_id) AS doc_id, a.n AS an, b.n AS bn FROM (SELECT doc_id, f, status, COUNT(*) AS n FROM l GROUP BY ALL) a
  FULL JOIN (SELECT doc_id, f, status, COUNT(*) AS n FROM r GROUP BY ALL) b ON a.doc_id = b.doc_id AND a.f = b.f AND a.status = b.status)
SELECT doc_id, SUM(an) IS NOT NULL AND SUM(bn) IS NOT NULL AS complete, SUM(an) IS NOT NULL AND SUM(bn) IS NOT NULL AND COUNT(*) FILTER (an IS DISTINCT FROM bn) = 0 AS equal,
  COUNT(*) FILTER (an IS DISTINCT FROM bn) AS different FROM j GROUP BY doc_id""")
def run_compare(t):
    base = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("f"), status().alias("status"))
    changed = base.withColumn("status", F.when((F.col("doc_id") % 97 == 0) & (F.col("f") == 1), "N/A").otherwise(F.col("status")))
    return P.run_equality(base.where("doc_id % 89 <> 0"), changed, "doc_id")


_PARTS_SQL = """SELECT doc_id, 'evaluations' AS part, CAST(f AS VARCHAR) AS name, status AS value FROM {run}
  UNION ALL SELECT doc_id, 'tests', CAST(test AS VARCHAR), CAST(day AS VARCHAR) FROM {run}
  UNION ALL SELECT doc_id, 'summary', status, CAST(COUNT(*) AS VARCHAR) FROM {run} GROUP BY doc_id, status"""


@query("run_parts", "A10", f"""
WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS f, {_STATUS_SQL} AS status, l_partkey AS test, CAST(l_shipdate AS DATE) AS day FROM lineitem),
r AS (SELECT CASE WHEN doc_id % 89 = 0 THEN -doc_id ELSE doc_id END AS doc_id, f, CASE WHEN doc_id % 97 = 0 AND f = 1 THEN 'N/A' ELSE status END AS status,
  CASE WHEN doc_id % 11 = 0 THEN test + f ELSE test END AS test, day FROM l),
a AS (SELECT doc_id, part, name, value, COUNT(*) AS n FROM ({_PARTS_SQL.format(run="l")}) GROUP BY ALL), b AS (SELECT doc_id, part, name, value, COUNT(*) AS n FROM ({_PARTS_SQL.format(run="r")}) GROUP BY ALL),
j AS (SELECT COALESCE(a.doc_id, b.doc_id) AS doc_id, COALESCE(a.part, b.part) AS part, a.n AS an, b.n AS bn
  FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.part = b.part AND a.name = b.name AND a.value = b.value)
SELECT doc_id, part, SUM(an) IS NOT NULL AND SUM(bn) IS NOT NULL AS complete, COUNT(*) FILTER (an IS DISTINCT FROM bn) = 0 AS equal,
  COUNT(*) FILTER (an IS DISTINCT FROM bn) AS different FROM j GROUP BY doc_id, part""")
def run_parts(t):
    left = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("f"), status().alias("status"), F.col("l_partkey").alias("test"),
                             F.col("l_shipdate").cast("date").alias("day"))
    k = F.col("doc_id")
    right = left.select(F.when(k % 89 == 0, -k).otherwise(k).alias("doc_id"), "f", F.when((k % 97 == 0) & (F.col("f") == 1), "N/A").otherwise(F.col("status")).alias("status"),
                        F.when(k % 11 == 0, F.col("test") + F.col("f")).otherwise(F.col("test")).alias("test"), "day")

    def parts(run):
        def rows(part, name, value):
            return run.select("doc_id", F.lit(part).alias("part"), F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value"))
        summary = run.groupBy("doc_id", "status").agg(F.count(F.lit(1)).cast("string").alias("value"))
        return (rows("evaluations", "f", "status").unionByName(rows("tests", "test", "day"))
                .unionByName(summary.select("doc_id", F.lit("summary").alias("part"), F.col("status").alias("name"), "value")))

    return P.part_equality(parts(left), parts(right), "doc_id", "part")


@query("corpus_report", "A11", """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 7 WHEN 0 THEN 'not_run' WHEN 1 THEN 'stale' WHEN 2 THEN 'inconsistent_counts' WHEN 3 THEN 'hold_mismatch'
  WHEN 4 THEN 'expectation_missing' WHEN 5 THEN 'holds_open' ELSE 'complete' END AS state FROM orders""")
def corpus_report(t):
    k = F.col("doc_id") % 7
    hold = F.when(k.isin(3, 5), 1).otherwise(0)
    audits = order_docs(t).where(k != 0).select(
        "doc_id", F.when(k == 1, "old").otherwise("e1").alias("engine"), F.lit(5).alias("pass"), F.lit(1).alias("fail"), hold.alias("hold"),
        (hold + F.when(k == 2, 9).otherwise(6)).alias("total"), F.when(k == 5, 1).otherwise(0).alias("holds_listed"), F.when(k == 4, 2).otherwise(0).alias("missing_expectations"))
    return P.corpus_report(order_docs(t), audits, "e1")


@query("implementation_audit", "A12", """
WITH c AS (SELECT l_partkey AS id, MIN(CASE l_suppkey % 4 WHEN 0 THEN 'implemented' WHEN 1 THEN 'observed' WHEN 2 THEN 'missing' ELSE 'zz' END) AS s, COUNT(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT CASE WHEN s = 'zz' THEN 'unknown' ELSE s END AS status, COUNT(*) AS entries, COUNT(*) FILTER (n > 1) AS repeated_ids FROM c GROUP BY ALL""")
def implementation_audit(t):
    name = F.get(F.array(*[F.lit(x) for x in ("implemented", "observed", "missing", "zz")]), (F.col("l_suppkey") % 4).cast("int"))
    return P.implementation_audit(t.lineitem.select(F.col("l_partkey").alias("entry_id"), name.alias("status")))


@query("rule_catalogue", "A16", f"""WITH {SPLIT_SQL},
l AS (SELECT doc_id, line_no, CASE line_no % 5 WHEN 0 THEN 's' || line_no END AS title, line_no % 5 AS k FROM raw),
p AS (SELECT *, LAST_VALUE(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM l)
SELECT doc_id, line_no, section, CASE k WHEN 1 THEN '제조 번호를 비교' WHEN 2 THEN '페이지 번호' ELSE '기타' END AS rule, CASE k WHEN 1 THEN 'lots' WHEN 2 THEN 'page_sequence' ELSE 'unmapped' END AS executor
FROM p WHERE k BETWEEN 1 AND 3""")
def rule_catalogue(t):
    k = F.col("line_no") % 5
    line = F.when(k == 0, F.concat(F.lit("## s"), "line_no")).when(k == 1, "- 제조 번호를 비교").when(k == 2, "-  페이지 번호").when(k == 3, "- 기타").otherwise("설명")
    return P.rule_catalogue(doc_lines(t).select("doc_id", "line_no", "block", line.alias("line")), ["doc_id"], "line_no")


@query("message_relations", "A15 F5", """
WITH m AS (SELECT conv_id AS message_id, turn, 'f' || turn || CASE WHEN conv_id % 3 = 0 OR turn % 2 = 1 THEN '_Per mit.pdf' ELSE '.pdf' END AS file, LENGTH(text) AS size_bytes, conv_id % 3 = 0 OR turn % 2 = 1 AS permit FROM conversations),
g AS (SELECT message_id, COUNT(*) AS n, BOOL_AND(permit) AS allp, ARG_MAX(file, (size_bytes, file)) AS largest FROM m GROUP BY message_id),
t AS (SELECT m.message_id, file, n, CASE WHEN permit AND NOT (allp AND n > 1 AND file = largest) THEN 'permit' ELSE 'sp' END AS type FROM m JOIN g USING (message_id))
SELECT message_id, file, type, COUNT(*) FILTER (type = 'sp') OVER w - CASE WHEN type = 'sp' THEN 1 ELSE 0 END AS related_sp,
  COUNT(*) FILTER (type = 'permit') OVER w - CASE WHEN type = 'permit' THEN 1 ELSE 0 END AS related_permits FROM t WINDOW w AS (PARTITION BY message_id)""")
def message_relations(t):
    permit = (F.col("conv_id") % 3 == 0) | (F.col("turn") % 2 == 1)
    files = t.conversations.select(F.col("conv_id").alias("message_id"), F.concat(F.lit("f"), "turn", F.when(permit, "_Per mit.pdf").otherwise(".pdf")).alias("file"), F.length("text").alias("size_bytes"))
    return I.message_relations(files)


@query("inbox_filter", "F3 F4", """
SELECT o_orderkey AS doc_id FROM orders WHERE CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END >= DATE '1997-01-01' AND o_orderkey % 4 <> 1 AND o_orderpriority = '2-HIGH'""")
def inbox_filter(t):
    o = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    docs = t.orders.select(o.alias("doc_id"), F.when(o % 3 == 0, "unreadable").otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).alias("received_at"),
                           F.when(o % 3 == 0, F.date_add(day, 10)).otherwise(F.lit("1990-01-01").cast("date")).alias("file_time"),
                           F.when(o % 4 == 1, "품목 허가증.pdf").otherwise("sp.pdf").alias("file"), F.lit(None).cast("string").alias("type"), F.concat(F.lit("RE: "), "o_orderpriority").alias("subject"))
    return I.inbox_documents(docs, "1997-01-01").where(I.subject_matches(F.col("subject"), " 2-high ")).select("doc_id")


@query("inbox_status", "A13", """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'pending' WHEN 2 THEN 'pending' WHEN 3 THEN 'failed' WHEN 4 THEN 'pending' ELSE 'completed' END AS state,
  CASE WHEN o_orderkey % 6 = 5 THEN o_custkey % 20 + 2 END AS total FROM orders""")
def inbox_status(t):
    k, n = F.col("doc_id") % 6, F.col("o_custkey") % 20
    base = t.wide("orders", F.col("o_orderkey").alias("doc_id"), "o_custkey")
    same = {name: F.lit("v1") for name in I.FINGERPRINTS}
    docs = base.select("doc_id", "o_custkey", *[v.alias(c) for c, v in same.items()], F.lit(10).alias("size"), F.lit(20).alias("mtime"))
    now = base.where(k != 0).select(
        "doc_id", F.lit(2).alias("updated_at"), *[v.alias(c) for c, v in same.items() if c != "permit_fingerprint"], F.when(k == 1, "v0").otherwise("v1").alias("permit_fingerprint"),
        F.when(k == 2, 11).otherwise(10).alias("size"), F.lit(20).alias("mtime"), F.when(k == 3, "failed").otherwise("completed").alias("status"),
        F.when(k == 4, 0).otherwise(n + 1).cast("bigint").alias("pass"), F.lit(0).cast("bigint").alias("fail"), F.lit(1).cast("bigint").alias("hold"), F.when(k == 4, 1).otherwise(n + 2).cast("bigint").alias("total"))
    earlier = now.withColumns({"updated_at": F.lit(1), "status": F.lit("completed"), "permit_fingerprint": F.lit("v1"), "size": F.lit(10)})
    return I.inbox_status(docs, now.unionByName(earlier))


@query("reference_choice", "F7", """
WITH l AS (SELECT s_suppkey, s_nationkey AS company, s_suppkey % 7 AS product FROM supplier), d AS (SELECT c_custkey, c_nationkey AS company, c_custkey % 9 AS product FROM customer)
SELECT c_custkey AS doc_id, CASE WHEN e.n > 0 THEN 1 WHEN p.n > 0 THEN 2 ELSE 3 END AS rank, COALESCE(e.n, p.n) AS "references", COALESCE(e.r, p.r) AS first_ref
FROM d LEFT JOIN (SELECT company, product, COUNT(*) AS n, MIN(s_suppkey) AS r FROM l GROUP BY ALL) e ON e.company = d.company AND e.product = d.product
LEFT JOIN (SELECT product, COUNT(*) AS n, MIN(s_suppkey) AS r FROM l GROUP BY ALL) p ON p.product = d.product""")
def reference_choice(t):
    library = t.supplier.select(F.col("s_nationkey").alias("company"), (F.col("s_suppkey") % 7).alias("product"), F.col("s_suppkey").alias("ref_id"))
    return I.references_for(t.customer.select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("company"), (F.col("c_custkey") % 9).alias("product")), library)


@query("version_gate", "A14", """
SELECT c_custkey AS doc_id, CASE WHEN NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey) THEN 'product_unknown' WHEN c_custkey % 4 = 0 THEN 'version_unknown' WHEN c_custkey % 4 = 1 THEN 'ok'
  WHEN c_custkey % 4 = 2 THEN 'ok' ELSE 'version_mismatch' END AS gate FROM customer""")
def version_gate(t):
    k = F.col("c_custkey") % 4
    docs = t.customer.select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("company"), F.lit("p").alias("product"),
                             F.when(k == 1, "Ver. 1.3").when(k == 2, "v1.3 ").when(k == 3, "Version 1.4").alias("version"))
    return I.version_gate(docs, t.supplier.select(F.col("s_nationkey").alias("company"), F.lit("p").alias("product")), "1.3")


@query("stale_results", "W5 U5", """
SELECT o_orderkey AS doc_id, o_orderkey % 5 IN (0, 1) AS stale FROM orders""")
def stale_results(t):
    k = F.col("doc_id") % 5
    inputs = t.wide("orders", F.col("o_orderkey").alias("doc_id"), fingerprint(F.col("o_totalprice"), F.col("o_orderdate")).alias("signature"))
    statuses = inputs.withColumn("signature", F.when(k == 0, F.lit("old")).otherwise(F.col("signature")))
    return I.stale_results(statuses, inputs.where(k != 1))


@query("link_history", "W6", """
SELECT o_custkey AS doc_id, o_orderkey AS linked_at, o_orderkey % 50 AS permit_id, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS replaced_at FROM orders""")
def link_history(t):
    return I.link_history(t.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("linked_at"), (F.col("o_orderkey") % 50).alias("permit_id")))


# ---- sources and sinks

@query("accept_submissions", "S1", """
WITH d AS (SELECT doc_id, doc_id // 40 AS batch, CASE WHEN doc_id % 3 = 0 THEN '%PDF-' || text WHEN doc_id % 3 = 1 THEN text ELSE '' END AS c FROM documents WHERE doc_id % 40 < 20 + (doc_id // 40) % 20),
b AS (SELECT *, COUNT(*) OVER (PARTITION BY batch) AS n FROM d)
SELECT doc_id, n AS batch_files, c LIKE '\\%PDF-%' ESCAPE '\\' AND n <= 30 AS accepted, CASE WHEN c LIKE '\\%PDF-%' ESCAPE '\\' AND n <= 30 THEN SHA256(c) END AS sha256 FROM b""")
def accept_submissions(t):
    d = F.col("doc_id")
    text = F.when(d % 3 == 0, F.concat(F.lit("%PDF-"), "text")).when(d % 3 == 1, F.col("text")).otherwise("")
    files = t.wide("documents", "doc_id", "text").where(d % 40 < 20 + F.floor(d / 40) % 20).select("doc_id", F.floor(d / 40).alias("batch"), text.cast("binary").alias("content"))
    return S.accept_submissions(files.withColumn("length", F.octet_length("content")), "batch").select("doc_id", "batch_files", "accepted", "sha256")


@query("record_scan", "S3", """
SELECT o_orderkey AS doc_id, CASE WHEN i = 0 THEN 7.5 ELSE CAST(i AS DOUBLE) END AS order_idx, 'T' || i AS test_name, CAST(o_custkey AS VARCHAR) AS result, CASE WHEN i = 0 THEN CAST(o_custkey % 9 AS INT) END AS page_start
FROM orders, (VALUES (0), (2)) v(i)""")
def record_scan(t):
    c = F.col("o_custkey")
    text = F.concat(F.lit('[{"test_name":"T0","order_idx":7.5,"result":"'), c, F.lit('","page_start":'), c % 9, F.lit('},"stray",{"test_name":"T2","result":"'), c, F.lit('"},null]'))
    found = S.records_from_json(t.wide("orders", "o_orderkey", "o_custkey").withColumnRenamed("o_orderkey", "doc_id"), "doc_id", text)
    return found.select("doc_id", "order_idx", "test_name", "result", "page_start")


@query("knowledge_load", "S4", """
WITH s AS (SELECT 0 AS rank, 'k' || doc_id AS doc_key, text, CASE WHEN doc_id % 11 = 0 THEN 'permit' ELSE lang END AS domain, 'documents' AS source FROM documents
  UNION ALL SELECT 1, 'k' || (conv_id * 10 + turn), text, 'talk', 'conversations' FROM conversations UNION ALL SELECT 2, 'k' || (item_id + 100000), text, 'bench', 'benchmark' FROM benchmark),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_key ORDER BY rank) AS n FROM s),
c AS (SELECT *, REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(TRANSLATE(text, CHR(160) || CHR(12288) || CHR(13), '  ' || CHR(10)), '[ \\t]+', ' ', 'g'), '\\n{2,}', CHR(10), 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM f WHERE n = 1)
SELECT doc_key, domain, source, LENGTH(clean) AS chars FROM c WHERE LENGTH(clean) >= 20 AND domain <> 'permit'""")
def knowledge_load(t):
    key = lambda x: F.concat(F.lit("k"), x)
    d = F.col("doc_id")
    docs = t.wide("documents", key(d).alias("doc_key"), "text", F.when(d % 11 == 0, "permit").otherwise(F.col("lang")).alias("domain"), F.lit("documents").alias("source"))
    talk = t.conversations.select(key(F.col("conv_id") * 10 + F.col("turn")).alias("doc_key"), "text", F.lit("talk").alias("domain"), F.lit("conversations").alias("source"))
    bench = t.benchmark.select(key(F.col("item_id") + 100000).alias("doc_key"), "text", F.lit("bench").alias("domain"), F.lit("benchmark").alias("source"))
    return S.knowledge([docs, talk, bench]).select("doc_key", "domain", "source", F.length("text").alias("chars"))


@query("rule_integrity", "S5 U1", """
WITH r AS (SELECT c_nationkey AS book, 'R' || (c_custkey % 40) AS rule_id, CASE WHEN c_custkey % 23 = 0 THEN 'guess' ELSE 'expiry' END AS op, CASE WHEN c_custkey % 5 = 0 THEN 'R' || (c_custkey % 45) END AS parent,
  CASE WHEN c_custkey % 7 = 0 THEN 'A.' || (c_custkey % 30) END AS req FROM customer)
SELECT DISTINCT book, rule_id, 'repeated_id' AS error FROM r GROUP BY ALL HAVING COUNT(*) > 1
UNION SELECT book, rule_id, 'unknown_operation' FROM r WHERE op = 'guess'
UNION SELECT book, rule_id, 'unknown_dependency' FROM r WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r b WHERE b.book = r.book AND b.rule_id = r.parent)
UNION SELECT book, rule_id, 'self_dependency' FROM r WHERE parent = rule_id
UNION SELECT book, rule_id, 'unknown_requirement' FROM r WHERE req IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = r.book AND r.req = 'A.' || n_regionkey)""")
def rule_integrity(t):
    c = F.col("c_custkey")
    rules = t.customer.select(F.col("c_nationkey").alias("book"), F.concat(F.lit("R"), c % 40).alias("rule_id"), F.when(c % 23 == 0, "guess").otherwise("expiry").alias("operation"),
                              F.when(c % 5 == 0, F.concat(F.lit("R"), c % 45)).alias("parent_id"), F.when(c % 7 == 0, F.concat(F.lit("A."), c % 30)).alias("requirement_id"))
    requirements = t.nation.select(F.col("n_nationkey").alias("book"), F.concat(F.lit("A."), "n_regionkey").alias("requirement_id"))
    return rulesets.rule_errors(rules, requirements)


@query("alias_overlap", "S5 U3", """
SELECT c_nationkey AS book, LOWER(c_mktsegment) AS product, COUNT(*) AS n FROM customer GROUP BY c_nationkey, LOWER(c_mktsegment), c_custkey % 3 HAVING COUNT(*) > 1""")
def alias_overlap(t):
    value = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("값 ")).otherwise(F.lit("값")), F.col("c_custkey") % 3)
    rows = t.customer.select(F.col("c_nationkey").alias("book"), F.col("c_mktsegment").alias("product"), F.lit("t").alias("test"), F.lit("c").alias("criteria"), value.alias("value"))
    return rulesets.overlapping_aliases(rows).select("book", "product", "n")


@query("summary_read", "S6", """
SELECT o_orderkey AS doc_id, 'S' || i AS name, CASE i WHEN 1 THEN o_custkey % 9 ELSE 3 END AS pass, CASE i WHEN 1 THEN o_custkey % 9 + 3 ELSE CASE WHEN o_orderkey % 4 = 0 THEN 9 ELSE 6 END END AS total,
  CASE i WHEN 1 THEN o_orderkey % 5 <> 0 ELSE o_orderkey % 4 <> 0 END AS usable FROM orders, (VALUES (1), (2)) v(i)""")
def summary_read(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey") % 9
    rows = F.array_compact(F.array(
        F.concat(F.lit("S1,"), c, F.lit(",1,2,"), c + 3), F.when(o % 5 == 0, F.concat(F.lit("S1,"), c, F.lit(",1,2,"), c + 3)),
        F.concat(F.lit("S2,3,2,1,"), F.when(o % 4 == 0, 9).otherwise(6)), F.concat(F.lit("합계,"), c + 3, F.lit(",3,3,"), c + 9)))
    texts = t.wide("orders", "o_orderkey", "o_custkey").select(o.alias("doc_id"), F.explode(rows).alias("line"))
    return S.summary_rows(texts, "doc_id", F.col("line")).select("doc_id", "name", "pass", "total", "usable")


@query("stage_sink", "S7 S10", f"""
SELECT l_returnflag AS stage, {_STATUS_SQL} AS status, COUNT(*) AS rows FROM lineitem GROUP BY ALL""")
def stage_sink(t):
    folder = f"{shared_folder(t.spark)}/stages-{uuid.uuid4().hex}"
    evaluations = t.lineitem.select(F.col("l_returnflag").alias("stage"), "l_orderkey", "l_linenumber", status().alias("status"))
    writers.write_stages(evaluations, folder)
    stored = t.spark.read.schema("l_orderkey bigint, l_linenumber int, status string, stage string").option("header", True).csv(folder)
    return stored.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("rows"))
