"""Literal cases of the parsing and verdict expressions."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from attestra.functions import codes as C
from attestra.functions import dates as D
from attestra.functions import fields as Fi
from attestra.functions import lexicon
from attestra.functions import text as T
from attestra.functions import verdict as V
from attestra.functions.criterion import criterion
from attestra.functions.measure import measurement


@pytest.mark.parametrize("text,cvalue,cunit", [
    ("3.00 x 10^6 cells/mL", 3e6, "cells/mL"), ("3.00 × 10⁶ cells/mL 이상", 3e6, "cells/mL"), ("91%", 0.91, "fraction"),
    ("≤100.0EU/mL", 100.0, "EU/mL"), ("1,250 ㎍/mL", 1250.0, "μg/mL"), ("12 ug / mL", 12.0, "μg/mL"), ("7", 7.0, "scalar"),
    ("-2.5 nm", -2.5, "nm"), ("5 ng/mg of protein", 5.0, "ng/mg of protein"), ("2 x 10⁻² mg", 0.02, "mg"), ("8 회", 8.0, "회"),
])
def test_measurement(value, text, cvalue, cunit):
    got = value(measurement, t=text)
    assert got["cvalue"] == pytest.approx(cvalue) and got["cunit"] == cunit


@pytest.mark.parametrize("text", ["", "해당 없음", None])
def test_no_measurement(value, text):
    assert value(measurement, t=text) is None


@pytest.mark.parametrize("text,kind,op,bound,unit", [
    ("50.0~100.0%", "range", None, None, None), ("≥ 5 mg", "compare", ">=", 5.0, "mg"), ("5 mg 미만", "compare", "<", 5.0, "mg"),
    ("기준(0.25 mL) 이상", "compare", ">=", 0.25, "mL"), ("1회 투여량 이상(0.25 mL 이상)", "compare", ">=", 0.25, "mL"),
    ("3 x 10^6 cells/mL 초과", "compare", ">", 3e6, "cells/mL"), ("7.4", "exact", "==", 7.4, "scalar"), ("3회 이상", "unknown", None, None, None),
    ("적합하여야 함", "unknown", None, None, None),
])
def test_criterion(value, text, kind, op, bound, unit):
    got = value(criterion, t=text)
    assert (got["kind"], got["op"]) == (kind, op)
    if bound is not None:
        assert got["threshold"]["cvalue"] == pytest.approx(bound) and got["threshold"]["cunit"] == unit


def test_range_takes_the_unit_of_either_side(value):
    got = value(criterion, t="5,000 ~ 8,000 μg/mL")
    assert (got["lower"]["cvalue"], got["upper"]["cvalue"], got["lower"]["cunit"]) == (5000.0, 8000.0, "μg/mL")


@pytest.mark.parametrize("crit,res,status", [
    ("20 EU/mL 미만", "20 EU/mL 미만", "PASS"), ("20 EU/mL 미만", "20 EU/mL 이하", "FAIL"), ("20 EU/mL 이하", "5 EU/mL 미만", "PASS"),
    ("20 EU/mL 이하", "5 EU/mL 이상", None), ("20 EU/mL 이하", "25 EU/mL 이하", "FAIL"), ("20 EU/mL 이하", "5 mg 이하", None),
])
def test_limit(value, crit, res, status):
    got = value(lambda c, r: V.limit_expression(criterion(c), criterion(r)), c=crit, r=res)
    assert (got["status"] if got else None) == status


@pytest.mark.parametrize("result,status", [
    ("A: 1 pg/μL, B: < 5 pg/μL, C: 9 pg/μL", "PASS"), ("A: 1 pg/μL, B: ≤ 5 pg/μL, C: 9 pg/μL", "FAIL"), ("A: 1 pg/μL, B: 2 pg/μL", "HOLD"),
    ("A: 1 pg/μL, B: 2 ng/μL, C: 3 pg/μL", "HOLD"), ("A: 1 pg/μL, B: 2 pg/μL, C: 3", "HOLD"), ("A: 1 pg/μL, A: 2 pg/μL, C: 3 pg/μL", "HOLD"),
])
def test_minimum_count_needs_every_target(value, result, status):
    text = "A, B, C 유전자 중 2종 이상 정량한계(5 pg/μL) 미만"
    assert value(V.minimum_count, c=text, r=result)["status"] == status


def test_minimum_count_of_another_form_is_undecided(value):
    assert value(V.minimum_count, c="5 mg 이하", r="1 mg") is None
    assert value(V.minimum_count, c="2종 이상 정량한계 미만", r="A: 1 pg/μL")["status"] == "HOLD"


@pytest.mark.parametrize("result,status", [
    ("잔류 DNA: 3 ng/mL; 단백질: 12 %", "PASS"), ("단백질: 12 %, 잔류DNA: 40 ng/mL", "FAIL"), ("잔류 DNA: 3 ng/mL", "HOLD"),
    ("잔류 DNA: 3 ng/mL; 잔류 DNA: 3 ng/mL; 단백질: 12 %", "HOLD"),
])
def test_labelled_matches_by_name(value, result, status):
    assert value(lambda c, r: V.labelled(c, r, ["잔류 DNA", "단백질"]), c="잔류 DNA: 30 ng/mL 이하, 단백질: 10 % 이상", r=result)["status"] == status


def test_denied_observation_does_not_hide_a_finding(value):
    from attestra.functions.methods import unsuitable
    assert value(unsuitable, t="A 불검출, B 검출") is True
    assert value(unsuitable, t="A 불검출, B 미검출") is False


@pytest.mark.parametrize("crit,res,status", [
    ("구형이며 응집이 없을 것", "불규칙, 응집 없음", "FAIL"), ("균이 검출되지 않아야 함", "검출됨", "FAIL"), ("표준품과 동일하여야 함", "동일하지 않음", "FAIL"),
    ("무색 또는 담황색", "황색", "PASS"), ("육안관찰 시 성상은 변함없음", "성상 변화 없음", "PASS"), ("기타", "기타", None),
])
def test_lexicon(value, crit, res, status):
    got = value(lexicon.semantic, c=crit, r=res)
    assert (got["status"] if got else None) == status


@pytest.mark.parametrize("text,expected", [
    ("2024.01.05 ~ 2024-01-20", 2), ("2024.01.05부터 2024.02.30까지", 0), ("2024.01.05 ~", 0), ("2024.01.05 접수", 0), ("2024년 1월 5일", 1), ("", 0),
])
def test_complete_dates_reject_anything_unread(value, text, expected):
    assert len(value(D.complete_dates, t=text)) == expected


@pytest.mark.parametrize("text,expected", [
    ("1 개월", datetime.date(2024, 2, 29)), ("제조일로부터 13개월", datetime.date(2025, 2, 28)), ("1~2개월", None), ("1.5개월", None), ("한 달", None), (None, None),
])
def test_month_deadline(value, text, expected):
    assert value(lambda t: D.month_deadline(F.lit("2024-01-31").cast("date"), t), t=text) == expected


@pytest.mark.parametrize("text,seconds", [
    ("1시간 30분", 5400), ("90분", 5400), ("1d 2h 3min 4.5s", 93784.5), ("30분 1시간", None), ("1시간 60분", None), ("1.5시간 10분", None), ("5분 5분", None), ("5", None), ("5분 경", None),
])
def test_duration(value, text, seconds):
    got = value(D.duration_seconds, t=text)
    assert got == (None if seconds is None else Decimal(str(seconds)))


@pytest.mark.parametrize("text,ok", [
    ("2024-01-02 03:04", True), ("2024.1.2T03:04:05", True), ("2024년 1월 2일 3시 4분", True), ("2024-01.02 03:04", False), ("2024-01-02 03:04 KST", False), ("2024-02-30 01:00", False),
])
def test_timestamp(value, text, ok):
    assert (value(D.complete_timestamp, t=text) is not None) == ok


def test_interval_covers_the_written_precision(value):
    got = value(D.date_interval, t="2024.02 ~ 2024.03.05")
    assert (got["lo"], got["hi"]) == (datetime.date(2024, 2, 1), datetime.date(2024, 3, 5))
    got = value(D.date_interval, t="2023년")
    assert (got["lo"], got["hi"]) == (datetime.date(2023, 1, 1), datetime.date(2023, 12, 31))


@pytest.mark.parametrize("text,expected", [
    ("제조번호: A-1", "A-1"), ("제 조 번 호 | A-1 |", "A-1"), ("제조번호: A\n제조번호: B", None), ("제조번호목록: A", None), ("제조번호\n다음", None), ("제조번호 12", "12"),
])
def test_field_value_is_unique_or_nothing(value, text, expected):
    assert value(lambda t: Fi.field_value(t, "제조번호"), t=text) == expected


def test_quantities_and_codes(value):
    assert tuple(value(C.quantity, t="1,500.50 ㎖")) == ("1500.5", "ml")
    assert tuple(value(C.quantity, t="20 Vials")) == ("20", "vial")
    assert value(C.quantity, t="약 20 병") is None
    assert value(C.lot_code, t=" 26abc－01/a ") == "26ABC01A"


@pytest.mark.parametrize("text,number", [
    ("5.2 항원 시험", "5.2"), ("5.2항원바이알시험", "5.2"), ("1. 일반정보", "1"), ("3 원액 제조", "3"), ("8.5 이어야 한다.", None), ("0.25 mL", None), ("10 mg 이하", None), ("4.0 시험", None),
])
def test_heading(value, text, number):
    got = value(T.heading, t=text)
    assert (got["number"] if got else None) == number


def test_keys_fold_compatibility_forms(value):
    assert value(T.key, t="Ａ Ｂ㎖　① ") == "abml1"
    assert value(T.scientific, t="4.26 x 10 6개") == "4.26 x 10^6 개"


def test_text_quality(value):
    assert value(T.looks_corrupt, t="허가서 본문 시험") is False
    assert value(T.looks_corrupt, t="éèàçùâêîôû") is True
    assert value(lambda n, s: T.choose_page_text(n, s)["source"], n="", s="허가서") == "scan"
