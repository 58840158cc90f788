"""Parsing and judging of test records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon, methods, verdict as V
from ..functions.criterion import criterion
from ..functions.measure import measurement
from ..operators import judgement as J
from ..operators.distinct import once_per_text, per_text
from .records import KEYS, REC_SQL, records
from .registry import query


def _lines(t):
    return t.wide("lineitem", *KEYS, "l_quantity")


def _judged(base, verdict):
    """Status of a verdict over criterion and result, computed once per pair of texts."""
    return per_text(base, ["criteria", "result"], {"status": verdict["status"]}).select(*KEYS, "status")


_UNIT_SQL = """CASE WHEN n = 4 THEN 'IU/mL' WHEN n = 3 THEN 'scalar'
  WHEN l_linenumber = 4 THEN 'cells/mL' WHEN l_linenumber = 5 THEN 'μg/mL' ELSE 'mg' END"""
_VALUE_SQL = "CAST(CASE WHEN l_linenumber = 4 AND n <> 4 THEN q * 1000 ELSE q END AS DOUBLE)"
_BOUND_SQL = "CAST(CASE WHEN l_linenumber = 4 THEN s * 1000 ELSE s END AS DOUBLE)"
_NUMERIC_SQL = f"""CASE
  WHEN l_linenumber = 7 THEN NULL
  WHEN n = 4 AND l_linenumber <> 6 THEN 'FAIL'
  WHEN l_linenumber = 1 THEN CASE WHEN v <= b THEN 'PASS' ELSE 'FAIL' END
  WHEN l_linenumber = 2 THEN CASE WHEN v >= b THEN 'PASS' ELSE 'FAIL' END
  WHEN l_linenumber = 3 THEN CASE WHEN v BETWEEN b AND b + 20 THEN 'PASS' ELSE 'FAIL' END
  WHEN l_linenumber = 4 THEN CASE WHEN v < b THEN 'PASS' ELSE 'FAIL' END
  WHEN l_linenumber = 5 THEN CASE WHEN v > b THEN 'PASS' ELSE 'FAIL' END
  WHEN l_linenumber = 6 THEN CASE WHEN v = b THEN 'PASS' ELSE 'FAIL' END END"""
JUDGED_SQL = f"""{REC_SQL}, judged AS (
  SELECT *, {_NUMERIC_SQL} AS numeric_status
  FROM (SELECT *, {_VALUE_SQL} AS v, {_BOUND_SQL} AS b FROM rec))"""


@query("measurement_parse", "N1 N2 T3", f"""WITH {REC_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_VALUE_SQL} AS value, {_UNIT_SQL} AS unit FROM rec""")
def measurement_parse(t):
    parsed = per_text(records(t), ["result"], {"m": measurement(F.col("result"))})
    return parsed.select(*KEYS, F.col("m.cvalue").alias("value"), F.col("m.cunit").alias("unit"))


@query("criterion_parse", "N3", f"""WITH {REC_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber WHEN 3 THEN 'range' WHEN 6 THEN 'exact' WHEN 7 THEN 'unknown' ELSE 'compare' END AS kind,
  CASE l_linenumber WHEN 1 THEN '<=' WHEN 2 THEN '>=' WHEN 4 THEN '<' WHEN 5 THEN '>' WHEN 6 THEN '==' END AS op,
  CASE WHEN l_linenumber IN (1,2,4,5,6) THEN {_BOUND_SQL} END AS threshold,
  CASE WHEN l_linenumber = 3 THEN CAST(s AS DOUBLE) END AS lower_bound,
  CASE WHEN l_linenumber = 3 THEN CAST(s + 20 AS DOUBLE) END AS upper_bound
FROM rec""")
def criterion_parse(t):
    parsed = per_text(records(t), ["criteria"], {"c": criterion(F.col("criteria"))})
    return parsed.select(*KEYS, "c.kind", "c.op", F.col("c.threshold.cvalue").alias("threshold"),
                         F.col("c.lower.cvalue").alias("lower_bound"), F.col("c.upper.cvalue").alias("upper_bound"))


@query("judge_numeric", "G1", f"""WITH {JUDGED_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, numeric_status AS status,
  CASE l_linenumber WHEN 1 THEN '<=' WHEN 2 THEN '>=' WHEN 3 THEN 'between' WHEN 4 THEN '<' WHEN 5 THEN '>'
       WHEN 6 THEN '==' END AS comparator FROM judged""")
def judge_numeric(t):
    parse = lambda known: known.withColumns({"crit": criterion(F.col("criteria")), "res": measurement(F.col("result"))})
    judged = once_per_text(records(t), ["criteria", "result"], lambda known: parse(known).select("criteria", "result", V.numeric(F.col("crit"), F.col("res")).alias("v")))
    return judged.select(*KEYS, "v.status", "v.comparator")


@query("status_rollup", "G15 A1 S8", f"""WITH {JUDGED_SQL}
SELECT l_returnflag AS stage, COUNT(*) FILTER (COALESCE(numeric_status, 'HOLD') = 'PASS') AS pass,
  COUNT(*) FILTER (COALESCE(numeric_status, 'HOLD') = 'FAIL') AS fail,
  COUNT(*) FILTER (COALESCE(numeric_status, 'HOLD') = 'HOLD') AS hold, COUNT(*) AS total
FROM judged GROUP BY ROLLUP (l_returnflag)""")
def status_rollup(t):
    judged = J.judge(records(t))
    return J.status_counts(judged.select(F.col("l_returnflag").alias("stage"), "verdict.status"), ["stage"])


@query("judge_limit", "G2", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q,
  (l_partkey % 50) + 1 AS s, l_linenumber % 4 AS cf, l_suppkey % 4 AS rf FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN (cf < 2) <> (rf < 2) THEN NULL
    WHEN cf < 2 THEN CASE WHEN q < s THEN 'PASS' WHEN q > s THEN 'FAIL' WHEN cf = 0 AND rf = 1 THEN 'FAIL' ELSE 'PASS' END
    ELSE CASE WHEN q > s THEN 'PASS' WHEN q < s THEN 'FAIL' WHEN cf = 2 AND rf = 3 THEN 'FAIL' ELSE 'PASS' END END AS status
FROM c""")
def judge_limit(t):
    def limit(value, form):
        return (F.when(form == 0, F.concat(value, F.lit(" EU/mL 미만"))).when(form == 1, F.concat(F.lit("≤"), value, F.lit("EU/mL")))
                .when(form == 2, F.concat(F.lit("> "), value, F.lit(" EU/mL"))).otherwise(F.concat(value, F.lit(" EU/mL 이상"))))
    base = _lines(t).select(*KEYS, limit((F.col("l_partkey") % 50) + 1, F.col("l_linenumber") % 4).alias("criteria"),
                             limit(F.col("l_quantity").cast("bigint"), F.col("l_suppkey") % 4).alias("result"))
    parse = lambda known: known.withColumns({"crit": criterion(F.col("criteria")), "res": criterion(F.col("result"))})
    return once_per_text(base, ["criteria", "result"], lambda known: parse(known).select(
        "criteria", "result", V.limit_expression(F.col("crit"), F.col("res"))["status"].alias("status"))).select(*KEYS, "status")


@query("judge_nearest_band", "G3 N17", """
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) * 100 AS e1,
  CAST(l_quantity AS BIGINT) * 100 + 5000 AS e2, (l_partkey % 50 + 1) * 100 AS o1, (l_suppkey % 60) * 100 + 4500 AS o2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN LEAST(ABS(o1 - e1), ABS(o2 - e1)) / CAST(e1 AS DOUBLE) > 0.1
         OR LEAST(ABS(o1 - e2), ABS(o2 - e2)) / CAST(e2 AS DOUBLE) > 0.1 THEN 'FAIL' ELSE 'PASS' END AS status FROM b""")
def judge_nearest_band(t):
    q = F.col("l_quantity").cast("bigint") * 100
    base = _lines(t).select(*KEYS, F.concat(q, F.lit(" bp, "), F.format_number(q + 5000, 0), F.lit("bp의 밴드")).alias("criteria"),
                             F.concat(F.format_number((F.col("l_partkey") % 50 + 1) * 100, 0), F.lit(" bp / "),
                                      (F.col("l_suppkey") % 60) * 100 + 4500, F.lit(" BP")).alias("result"))
    return _judged(base, V.nearest_band(F.col("criteria"), F.col("result")))


@query("judge_quantification", "G4", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_suppkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS' WHEN 2 THEN 'FAIL' END AS status FROM lineitem""")
def judge_quantification(t):
    n = F.col("l_suppkey") % 4
    result = (F.when(n == 0, "정량한계 미만").when(n == 1, "검출되지 않음").when(n == 2, "LOQ 이상")
              .otherwise(F.concat(F.col("l_quantity").cast("int"), F.lit(" pg/mL"))))
    base = _lines(t).select(*KEYS, F.lit("정량한계(LOQ) 미만").alias("criteria"), result.alias("result"))
    return _judged(base, V.below_quantification(F.col("criteria"), F.col("result")))


@query("judge_min_count", "G5 R20", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 3 + 1 AS k,
  l_linenumber AS f FROM lineitem),
k AS (SELECT *, (CASE WHEN q < 25 THEN 1 ELSE 0 END) + (CASE WHEN f % 2 = 0 AND q = 25 OR q < 25 THEN 1 ELSE 0 END)
  + (CASE WHEN q * 2 < 25 THEN 1 ELSE 0 END) AS proven FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN f = 7 THEN 'HOLD' WHEN f = 5 THEN 'HOLD' WHEN proven >= k THEN 'PASS' ELSE 'FAIL' END AS status FROM k""")
def judge_min_count(t):
    q, f = F.col("l_quantity").cast("bigint"), F.col("l_linenumber")
    second = F.when(f % 2 == 0, "<").otherwise("≤")
    rows = F.concat(F.lit("E1A: "), q, F.lit(" pg/μL, E1B: "), second, F.lit(" "), q, F.lit(" pg / μL; "))
    third = (F.when(f == 7, F.lit("")).when(f == 5, F.concat(F.lit("hTERT: "), q * 2, F.lit(" ng/μL")))
             .otherwise(F.concat(F.lit("hTERT: "), q * 2, F.lit(".0 pg/µL"))))
    base = _lines(t).select(*KEYS, F.concat(F.lit("E1A, E1B, hTERT 유전자 중 "), F.col("l_suppkey") % 3 + 1,
                                             F.lit("종 이상 정량한계(25 pg/μL) 미만")).alias("criteria"),
                             F.concat(rows, third).alias("result"))
    return _judged(base, V.minimum_count(F.col("criteria"), F.col("result")))


@query("judge_labelled", "G6 R26", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q,
  l_partkey % 50 AS p, l_linenumber AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN f <> 7 AND (q > 30 OR (f <> 6 AND p < 10)) THEN 'FAIL'
       WHEN f = 7 AND (p < 10) THEN 'FAIL' WHEN f IN (6, 7) THEN 'HOLD' ELSE 'PASS' END AS status FROM c""")
def judge_labelled(t):
    q, p, f = F.col("l_quantity").cast("bigint"), F.col("l_partkey") % 50, F.col("l_linenumber")
    dna = F.concat(F.lit("잔류 DNA: "), q, F.lit(" ng/mL"))
    protein = F.concat(F.lit("단백질: "), p, F.lit(" %"))
    result = (F.when(f == 6, dna).when(f == 7, F.concat(dna, F.lit("; "), dna, F.lit("; "), protein))
              .when(f % 2 == 0, F.concat(protein, F.lit("\n"), dna)).otherwise(F.concat(dna, F.lit(", "), protein)))
    base = _lines(t).select(*KEYS, F.lit("잔류DNA: 30 ng/mL 이하, 단백질: 10 % 이상").alias("criteria"), result.alias("result"))
    return _judged(base, V.labelled(F.col("criteria"), F.col("result"), ["잔류 DNA", "단백질"]))


@query("judge_multi", "G7 N16", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q,
  l_partkey % 50 AS p, l_linenumber AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN f = 7 THEN 'FAIL' WHEN q <= 40 AND p BETWEEN 5 AND 30 THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN f = 7 THEN 1 ELSE 2 END AS results FROM c""")
def judge_multi(t):
    q, p, f = F.col("l_quantity").cast("bigint"), F.col("l_partkey") % 50, F.col("l_linenumber")
    result = F.when(f == 7, F.concat(q, F.lit(" mg"))).otherwise(F.concat(q, F.lit(" mg, "), p, F.lit(" nm")))
    base = _lines(t).select(*KEYS, F.lit("40 mg 이하, 5 ~ 30 nm").alias("criteria"), result.alias("result"))
    return per_text(base, ["criteria", "result"], {
        "status": V.several_requirements(F.col("criteria"), F.col("result"))["status"],
        "results": F.size(V.numeric_results(F.col("result")))}).select(*KEYS, "status", "results")


@query("judge_unit_veto", "G8", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN f = 6 THEN 'HOLD' WHEN f = 7 THEN NULL WHEN q > 40 THEN 'FAIL' END AS status FROM c""")
def judge_unit_veto(t):
    q, f = F.col("l_quantity").cast("bigint"), F.col("l_linenumber")
    result = (F.when(f == 6, F.concat(q, F.lit(" nm"))).when(f == 7, F.concat(q, F.lit(" mg, "), q + 1, F.lit(" mg")))
              .otherwise(F.concat(F.lit("37 nm, "), q, F.lit(" mg"))))
    base = _lines(t).select(*KEYS, F.lit("함량은 40 mg 이하").alias("criteria"), result.alias("result"))
    return _judged(base, V.unit_matched(F.col("criteria"), F.col("result")))


_PHRASES = [
    ("검출되지 않아야 함", "불검출", "PASS"), ("검출되지 않아야 함", "검출됨", "FAIL"),
    ("음성이어야 함", "음 성", "PASS"), ("음성이어야 함", "양성", "FAIL"), ("양성", "Positive", "PASS"),
    ("표준품과 일치하여야 함", "일치하지 않음", "FAIL"), ("표준품과 일치하여야 함", "일치함", "PASS"),
    ("실측치", "확인됨", "PASS"), ("실측치", "측정불가", "FAIL"), ("무색 또는 담황색", "황색의 액", "PASS"),
    ("성상은 변함 없음", "변화 있음", "FAIL"), ("표시량 이상", "표시량 이상 분출됨", "PASS"),
    ("무균", "오염 의심", "FAIL"), ("구형이며 응집이 없을 것", "둥근 형태, 응집 없음", "PASS"),
    ("구형이며 응집이 없을 것", "불규칙, 응집 없음", "FAIL"), ("구형이며 응집이 없을 것", "구형", None),
    ("판정 불가 문구", "기타", None),
]


def _case(column: str, values: list) -> str:
    rows = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {column} {rows} END"


@query("judge_lexicon", "G9", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {_case(f"(l_partkey % {len(_PHRASES)})", [p[2] for p in _PHRASES])} AS status FROM lineitem""")
def judge_lexicon(t):
    n = F.col("l_partkey") % len(_PHRASES)

    def pick(i):
        return F.get(F.array(*[F.lit(p[i]) for p in _PHRASES]), n.cast("int"))
    base = _lines(t).select(*KEYS, pick(0).alias("criteria"), pick(1).alias("result"))
    return _judged(base, lexicon.semantic(F.col("criteria"), F.col("result")))


_METHOD_NAMES = ["무균시험", "결핵균 부정시험", "마이코플라스마 부정시험", "발열성물질시험", "페놀 정량", "헴정량", "불용성미립자시험", "일반시험"]


@query("judge_methods", "G12 N18", """
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 8 AS k, CAST(l_quantity AS BIGINT) AS q,
  l_suppkey % 3 AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE
  WHEN k = 0 THEN CASE WHEN q < 14 THEN 'FAIL' WHEN w = 0 THEN 'PASS' WHEN w = 1 THEN 'FAIL' END
  WHEN k = 1 THEN CASE WHEN q < 42 THEN 'FAIL' WHEN w = 0 THEN 'PASS' WHEN w = 1 THEN 'FAIL' END
  WHEN k = 2 THEN CASE WHEN q < (CASE WHEN w = 2 THEN 28 ELSE 14 END) THEN 'FAIL' WHEN w = 0 THEN 'PASS' WHEN w = 1 THEN 'FAIL' END
  WHEN k = 3 THEN CASE WHEN q <= 13 THEN 'PASS' WHEN q >= 25 THEN 'FAIL' ELSE 'HOLD' END
  WHEN k = 4 THEN CASE WHEN q BETWEEN 45 AND 55 THEN 'PASS' ELSE 'FAIL' END
  WHEN k = 5 THEN CASE WHEN q <= 25 THEN 'PASS' ELSE 'FAIL' END
  WHEN k = 6 THEN CASE WHEN w = 0 THEN 'HOLD' WHEN q > 25 OR q % 7 > 3 THEN 'FAIL' ELSE 'PASS' END END AS status FROM m""")
def judge_methods(t):
    q, w, k = F.col("l_quantity").cast("int"), F.col("l_suppkey") % 3, F.col("l_partkey") % 8
    name = F.get(F.array(*[F.lit(x) for x in _METHOD_NAMES]), k.cast("int"))
    wording = F.when(w == 0, "균이 검출되지 않음").when(w == 1, "A 불검출, B 검출").otherwise("결과 참조")
    hundredth = F.concat(F.lit("0."), F.lpad(q.cast("string"), 2, "0"))
    result = (F.when(k < 3, wording).when(k == 3, F.concat(F.lit("합계 "), F.floor(q / 10), F.lit("."), q % 10, F.lit(" °C")))
              .when(k.isin(4, 5), hundredth)
              .when(k == 6, F.concat(F.lit("10 ㎛ 이상 "), q, F.lit(" EA/mL\n두 번째 크기의 입자에 대하여 따로 센 값은 25 um 이상: "), q % 7, F.lit(" EA/mL"))).otherwise("적합"))
    criteria = F.when(k == 6, F.when(w == 0, "■ 100 mL 미만").otherwise("☑ 100 mL 이상")).otherwise("")
    start = F.to_date(F.lit("2024-01-01"))
    period = F.concat(F.date_format(start, "yyyy.MM.dd"), F.lit(" ~ "), F.date_format(F.date_add(start, q - 1), "yyyy-M-d"))
    base = _lines(t).select(*KEYS, name.alias("test_name"), F.when((k == 2) & (w == 2), "증균 배양법").otherwise("").alias("method"),
                             criteria.alias("criteria"), result.alias("result"), F.when(k < 3, period).otherwise("").alias("test_period"))
    text = F.concat_ws("\n", "test_name", "method", "criteria", "result")
    v = methods.method_verdict(text, F.col("result"), F.col("criteria"), F.col("test_period"))
    return per_text(base, ["test_name", "method", "criteria", "result", "test_period"], {"status": v["status"]}).select(*KEYS, "status")


_CASCADE = [
    ("10 mg 이하", "적합", "PASS", "text_result"), ("10 mg 이하", "부적합", "FAIL", "text_result"),
    ("10 mg 이하", "{q} mg", "num", "<="), ("10 mg 이하", "{q} mg 이하", "num", "limit_expression"),
    ("불검출이어야 함", "불검출이어야 함", "HOLD", "echo"), ("10 mg 이하", "", "HOLD", "routing"),
    ("", "{q} mg", "HOLD", "routing"), ("검출되지 않아야 함", "검출되지 않음", "PASS", "confirmation"),
    ("100 mL: 25 ㎛ 이상 입자 EA/mL", "100 mL 기준: {q} EA/mL", "two", "particle_100ml"),
    ("음성", "negative", "PASS", "negative"), ("10 mg 이하, 5 nm 이하", "{q} mg", "FAIL", "multiple"),
    ("설명만 있음", "{q} mg", "HOLD", "routing"),
]


@query("judge_cascade", "G10 G11 G13 G14 G16 G19", f"""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q,
  l_partkey % {len(_CASCADE)} AS k FROM lineitem),
d AS (SELECT *, {_case("k", [c[2] for c in _CASCADE])} AS s, {_case("k", [c[3] for c in _CASCADE])} AS comparator FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, comparator,
  CASE s WHEN 'num' THEN CASE WHEN q <= 10 THEN 'PASS' ELSE 'FAIL' END
         WHEN 'two' THEN CASE WHEN q <= 2 THEN 'PASS' ELSE 'FAIL' END ELSE s END AS status FROM d""")
def judge_cascade(t):
    k = (F.col("l_partkey") % len(_CASCADE)).cast("int")
    q = F.col("l_quantity").cast("int").cast("string")
    result = F.replace(F.get(F.array(*[F.lit(c[1]) for c in _CASCADE]), k), F.lit("{q}"), q)
    base = _lines(t).select(*KEYS, F.get(F.array(*[F.lit(c[0]) for c in _CASCADE]), k).alias("criteria"), result.alias("result"))
    judged = J.judge(base)
    return judged.select(*KEYS, "verdict.status", "verdict.comparator")
