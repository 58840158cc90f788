"""Dates, codes, quantities, keys and notation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import dates as D
from ..functions import text as T
from ..functions.criterion import criterion
from ..functions.verdict import numeric_requirements
from ..operators import manufacturing as M
from ..operators import reports as P
from ..operators.distinct import per_text
from ..operators.rules import select
from .records import KEYS
from .registry import query
from .ruling import SHIFT, dotted, lines


@query("date_parts", "N4 N5", f"""
WITH l AS (SELECT l_orderkey, l_linenumber AS f, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) + {SHIFT} AS d FROM lineitem)
SELECT l_orderkey, f AS l_linenumber, l_partkey, l_suppkey, CASE WHEN f <> 7 THEN CAST(YEAR(d) AS INT) END AS y,
  CASE WHEN f NOT IN (6, 7) THEN CAST(MONTH(d) AS INT) END AS m, CASE WHEN f NOT IN (4, 5, 6, 7) THEN CAST(DAY(d) AS INT) END AS d,
  CASE WHEN f = 7 THEN FALSE WHEN f IN (4, 5, 6) THEN TRUE ELSE l_suppkey % 2 = 0 END AS same FROM l""")
def date_parts(t):
    f, d = F.col("f"), F.col("shipped")
    text = (F.when(f == 1, dotted(d)).when(f == 2, F.date_format(d, "yyyy년 M월 d일")).when(f == 3, F.concat(F.lit("시험일 "), F.date_format(d, "yyyy-M-d"), F.lit(" 시행")))
            .when(f == 4, F.date_format(d, "yyyy/MM")).when(f == 5, F.date_format(d, "yyyy년 MM월")).when(f == 6, F.date_format(d, "yyyy년")).otherwise("2024.13.45"))
    other = F.when(F.col("l_suppkey") % 2 == 0, d).otherwise(F.when(F.dayofmonth(d) > 1, F.date_sub(d, 1)).otherwise(F.date_add(d, 1)))
    rows = per_text(lines(t).withColumn("text", text), ["text"], {"p": D.date_parts(F.col("text"))})
    rows = per_text(rows.withColumn("other", F.date_format(other, "yyyy．M．d")), ["other"], {"o": D.date_parts(F.col("other"))})
    return rows.select(F.col("doc_id").alias("l_orderkey"), F.col("f").alias("l_linenumber"), "l_partkey", "l_suppkey", "p.y", "p.m", "p.d",
                       D.same_date(F.col("p"), F.col("o")).alias("same"))


@query("durations", "N10", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE l_linenumber WHEN 1 THEN q * 3600 WHEN 2 THEN 86400 + (q % 24) * 3600 + 30 WHEN 3 THEN 5400.5 WHEN 4 THEN q * 60 + 7.25 END AS DECIMAL(38,10)) AS seconds
FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem)""")
def durations(t):
    q, f = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    text = (F.when(f == 1, F.concat(q, F.lit("시간"))).when(f == 2, F.concat(F.lit("1d "), q % 24, F.lit(" h 30 S"))).when(f == 3, "1.5시간 0.5초")
            .when(f == 4, F.concat(F.lit("0시간 "), q, F.lit("분 7.25초"))).when(f == 5, "30분 1시간").when(f == 6, "90분 60초 경과").otherwise("1시간 75분"))
    fixed = F.when(f == 3, "1시간 30분 0.5초").otherwise(text)
    return t.wide("lineitem", *KEYS, "l_quantity").select(*KEYS, D.duration_seconds(fixed).alias("seconds"))


@query("codes_and_quantities", "N11 N12", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '26ABC' || l_partkey || 'A' AS code,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) ELSE CAST(CAST(l_quantity AS INT) * 1000 AS VARCHAR) || '.5' END AS number,
  CASE l_linenumber WHEN 1 THEN 'ml' WHEN 2 THEN 'vial' WHEN 3 THEN 'vial' WHEN 4 THEN 'dose' WHEN 5 THEN 'l' WHEN 6 THEN '' END AS unit FROM lineitem""")
def codes_and_quantities(t):
    q, f = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    code = F.concat(F.lit("26abc"), F.when(f % 2 == 0, F.lit(" - ")).otherwise(F.lit("－")), F.col("l_partkey"), F.lit("/a"))
    unit = F.get(F.array(*[F.lit(u) for u in ("㎖", " 바이알", "EA", " Doses", " ℓ", "")]), f - 1)
    text = F.when(f == 7, "약 10병").when(f % 2 == 0, F.concat(q, F.lit(".00"), unit)).otherwise(F.concat(F.format_number(q * 1000, 0), F.lit(".50"), unit))
    rows = t.wide("lineitem", *KEYS, "l_quantity").select(*KEYS, C.lot_code(code).alias("code"), C.quantity(text).alias("v"))
    return rows.select(*KEYS, "code", "v.number", "v.unit")


@query("stage_names", "N13", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ecoli마스터세포주' WHEN 1 THEN 'cho제조용세포주' WHEN 2 THEN 'componenta중간체원액' WHEN 3 THEN '나노파티클' ELSE '완제의약품' END AS stage,
  CASE o_orderkey % 5 WHEN 0 THEN 'ecoli,마스터세포주,세포주' WHEN 1 THEN 'cho,제조용세포주,세포주' WHEN 2 THEN 'componenta,component,중간체원액,중간체,원액' WHEN 3 THEN '나노파티클,나노' ELSE '완제의약품,완제,의약품' END AS words FROM orders""")
def stage_names(t):
    names = ["E. colli 마스터 세포주", "CHOL_제조용 세포주", "컴포넌트 A [중간체 원액]", "나노피티클", "완제 · 의약품"]
    name = F.get(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % 5).cast("int"))
    rows = t.wide("orders", "o_orderkey").withColumn("stage", M.stage_key(name))
    return rows.withColumn("words", F.array_join(M.stage_terms(F.col("stage")), ","))


@query("status_words", "N15", """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'HOLD' WHEN 3 THEN 'N/A' WHEN 4 THEN 'FAIL' WHEN 5 THEN 'PASS' ELSE 'HOLD' END AS status FROM orders""")
def status_words(t):
    pairs = [("검수 합격", ""), ("부적합", "적합"), ("판정보류", ""), ("N/A", ""), ("", "기준을 벗어나 불합격"), ("?", "Passed"), (None, None)]
    k = (F.col("o_orderkey") % 7).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(p[i]).cast("string") for p in pairs]), k)
    return t.wide("orders", "o_orderkey").withColumn("status", C.status_word(pick(0), pick(1)))


@query("comparison_keys", "F1 T20 T3", """
SELECT c_custkey, LOWER(c_mktsegment) || 'ml(' || c_nationkey || ')' AS key, 'ug/mL mm[Hg] mmHg ' || c_nationkey AS search, '4.26 x 10^' || (c_nationkey % 9 + 1) || ' 개' AS scientific FROM customer""")
def comparison_keys(t):
    n = F.col("c_nationkey")
    wide_letters = F.translate("c_mktsegment", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ")
    k = n % 9 + 1
    powers = F.translate(k.cast("string"), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    notation = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("4.26×10 "), k, F.lit("개"))).otherwise(F.concat(F.lit("4.26 x 10"), powers, F.lit("개")))
    return t.wide("customer", "c_custkey", "c_nationkey", "c_mktsegment").select(
        "c_custkey", T.key(F.concat(wide_letters, F.lit(" ㎖（ "), n, F.lit(" ）"))).alias("key"),
        T.search_form(F.concat(F.lit("㎍/㎖ mmHg  "), n)).alias("search"), T.scientific(notation).alias("scientific"))


@query("rule_selector", "F1", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 3 = 0 AND l_suppkey % 2 = 0 AND l_partkey % 4 = 1""")
def rule_selector(t):
    rows = t.wide("lineitem", *KEYS).withColumns({
        "record_type": F.when(F.col("l_linenumber") % 3 == 0, "test").otherwise("content"),
        "section_title": F.when(F.col("l_suppkey") % 2 == 0, "3. 최종  원액 ＣＨＯ 시험").otherwise("3. 원액 시험"),
        "test_name": F.concat(F.lit("단백질 "), F.when(F.col("l_partkey") % 4 == 1, "정 량").otherwise("확인"), F.lit("시험"))})
    return select(rows, {"type": "test", "context": ["최종원액", "cho"], "test": "단백질정량"}).select(*KEYS)


@query("declarative_match", "F6 G17", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'gel' WHEN 1 THEN 'gel' WHEN 2 THEN 'titer' WHEN 3 THEN 'titer' WHEN 4 THEN 'look' END AS rule_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN CASE WHEN o_custkey % 100 >= 50 THEN 'PASS' ELSE 'FAIL' END WHEN 3 THEN 'PASS' WHEN 4 THEN 'PASS' END AS status FROM orders""")
def declarative_match(t):
    rules = [dict(id="gel", match={"test_name_any": ["제한효소", "PCR"], "criteria_all": ["bp"]}, decide="bp_contains_all", sizes=[500, 1200]),
             dict(id="titer", match={"test_name_any": ["역가"]}, decide="numeric_min_or_text", minimum=50, pass_terms=["적합"]),
             dict(id="look", match={"test_name_all": ["성상"]}, decide="terms_confirmed", terms=["무색", "투명"])]
    k = F.col("o_orderkey") % 6
    name = F.when(k < 2, "제한 효소 지도").when(k < 4, "역 가").when(k == 4, "성상").otherwise("기타")
    result = F.when(k == 0, "500 bp, 1,200 bp").when(k == 1, "500 bp").when(k == 2, F.concat(F.col("o_custkey") % 100, F.lit(" IU"))).when(k == 3, "적합").otherwise("무색의 투명한 액")
    rows = t.wide("orders", "o_orderkey", "o_custkey").withColumns({"test_name": name, "criteria": F.lit("500, 1,200 bp"), "result": result})
    return P.declarative_rules(rows, rules).select("o_orderkey", "decision.rule_id", "decision.status")


@query("notation_rewrite", "G18", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 90) || ' μg/mL' ELSE (o_custkey % 90) || ' mcg/mL' END AS result_compared, o_orderkey % 2 = 0 AS rewritten FROM orders""")
def notation_rewrite(t):
    rows = t.wide("orders", "o_orderkey", "o_custkey").withColumns({
        "test_name": F.when(F.col("o_orderkey") % 2 == 0, "단백질 정량").otherwise("함량"), "criteria": F.lit("10 μg/mL 이하"),
        "result": F.concat(F.col("o_custkey") % 90, F.lit(" mcg/mL"))})
    return P.rewrite_notation(rows, [{"test": "단백질", "from": "mcg/mL", "to": "μg/mL"}]).select("o_orderkey", "result_compared", "rewritten")


@query("table_below_count", "G4 B3", """
WITH r AS (SELECT l_orderkey AS doc_id, CASE l_suppkey % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'b' WHEN 2 THEN 'a' ELSE CASE WHEN l_linenumber = 7 THEN 'u' ELSE 'a' END END AS k FROM lineitem),
g AS (SELECT doc_id, COUNT(*) FILTER (k = 'b') AS below, COUNT(*) FILTER (k = 'a') AS above, COUNT(*) AS n FROM r GROUP BY doc_id)
SELECT doc_id, 2 AS needed, below, CASE WHEN below >= 2 THEN 'PASS' WHEN below + above = n THEN 'FAIL' END AS status FROM g""")
def table_below_count(t):
    n = F.col("l_suppkey") % 4
    result = F.when(n == 0, "정량한계 미만").when(n == 1, "불검출").when((n == 3) & (F.col("l_linenumber") == 7), "시험 중").otherwise("LOQ 이상")
    rows = t.wide("lineitem", F.col("l_orderkey").alias("doc_id"), F.lit("유전자 중 2 종 이상이 정량한계 미만").alias("criteria"), result.alias("result"))
    return P.table_below_count(rows, ["doc_id"])


@query("range_remarks", "T17", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'range' WHEN 1 THEN 'composite' ELSE '' END AS remark FROM orders""")
def range_remarks(t):
    k = F.col("o_orderkey") % 3
    criteria = F.when(k == 0, F.concat(F.col("o_custkey") % 9, F.lit(" ~ 20 mg"))).when(k == 1, "10 mg 이하, 5 % 이상").otherwise("10 mg 이하")
    rows = t.wide("orders", "o_orderkey", "o_custkey").withColumn("criteria", criteria)
    flags = F.array_compact(F.array(F.when(criterion(F.col("criteria"))["kind"] == "range", F.lit("range")),
                                    F.when(F.size(numeric_requirements(F.col("criteria"))) > 1, F.lit("composite"))))
    return per_text(rows, ["criteria"], {"remark": F.array_join(flags, "; ")}).select("o_orderkey", "remark")
