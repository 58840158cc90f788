"""General test-method rules: the first method whose wording occurs in the record decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import particle_counts
from .core import contains_any, let, sub
from .dates import test_days
from .fields import numbers
from .text import clean, compact
from .verdict import VERDICT, pass_if, verdict


@dataclass(frozen=True)
class Method:
    name: str
    wording: tuple[str, ...]
    kind: str
    low: float | None = None
    high: float | None = None
    min_days: int | None = None
    long_wording: tuple[str, ...] = ()
    long_days: int | None = None


# Methods in decision order with their limits.
METHODS = [
    Method("tuberculosis", ("결핵균부정시험",), "absence", min_days=42),
    Method("mycoplasma", ("마이코플라스마부정시험",), "absence", min_days=14,
           long_wording=("증균배양", "멤브레인필터", "멤브레인"), long_days=28),
    Method("sterility", ("무균시험",), "absence", min_days=14),
    Method("pyrogen", ("발열성물질시험",), "pyrogen", low=1.3, high=2.5),
    Method("heat_stability", ("열안정성시험",), "absence"),
    Method("thimerosal", ("치메로살정량", "치메로살"), "range", low=80, high=120),
    Method("phenol", ("폐놀정량", "페놀정량"), "range", low=0.45, high=0.55),
    Method("haem", ("헴정량", "혈색소"), "maximum", high=0.25),
    Method("fluorescent_antibody", ("형광항체시험",), "presence"),
    Method("particles", ("불용성미립자",), "particles", low=25.0, high=3.0),
    Method("foreign_matter", ("불용성이물",), "absence"),
    Method("actual_volume", ("실용량시험",), "volume"),
    Method("endotoxin", ("엔도톡신",), "endotoxin"),
]

# Wording of a suitable result; denied observations are removed before looking for findings.
_SUITABLE = ["적합", "음성", "불검출", "미검출", "없음"]
_SUITABLE_COMPACT = ["인정되지않", "관찰되지않", "확인되지않", "검출되지않", "증식하지않", "발육하지않"]
_DENIED = r"불검출|미검출|(?:인정|관찰|확인|검출)되지않(?:음|았음|았다)?|(?:증식|발육)하지않(?:음|았음|았다)?"
_FOUND = ["검출", "확인됨", "관찰됨", "인정됨", "증식", "발육"]
# Marks of the selected container class.
_SMALL_CLASS = ["■100mL미만", "☑100mL미만", "[x]100mL미만"]
_LARGE_CLASS = ["100mL이상"]


def suitable(text: Column) -> Column:
    return ~text.contains("부적합") & (contains_any(text, _SUITABLE) | contains_any(compact(text), _SUITABLE_COMPACT))


def unsuitable(text: Column) -> Column:
    return contains_any(text, ["부적합", "양성"]) | contains_any(sub(compact(text), _DENIED, ""), _FOUND)


def _decide(method: Method, result: Column, criteria: Column, record_key: Column, days: Column) -> Column:
    good, bad = suitable(result), unsuitable(result)
    values = numbers(result)
    first = F.get(values, F.lit(0))
    name = method.name
    if method.kind == "absence":
        minimum = F.lit(method.min_days)
        if method.long_wording:
            minimum = F.when(contains_any(record_key, list(method.long_wording)), F.lit(method.long_days)).otherwise(minimum)
        short = F.lit(False) if method.min_days is None else F.coalesce(days < minimum, F.lit(False))
        external = contains_any(compact(criteria), ["별도규정", "각조", "허가받은기준"])
        return (F.when(short, verdict("FAIL", name, "period_too_short")).when(bad, verdict("FAIL", name, "found"))
                .when(good, verdict("PASS", name, "not_found")).when(external, verdict("HOLD", name, "wording_unclear")))
    if method.kind == "range":
        fallback = F.when(good, verdict("PASS", name, "stated")) if name == "thimerosal" else F.lit(None).cast(VERDICT)
        return F.when(first.isNotNull(), pass_if(first.between(method.low, method.high), name, "range")).otherwise(fallback)
    if method.kind == "maximum":
        return F.when(first.isNotNull(), pass_if(first <= method.high, name, "maximum"))
    if method.kind == "pyrogen":
        top = F.array_max(values)
        return (F.when(top <= method.low, verdict("PASS", name, "reaction")).when(top >= method.high, verdict("FAIL", name, "reaction"))
                .when(top.isNotNull(), verdict("HOLD", name, "retest_zone"))
                .when(good, verdict("PASS", name, "stated")).when(bad, verdict("FAIL", name, "stated")))
    if method.kind == "presence":
        return F.when(good | contains_any(result, ["양성", "형광"]), verdict("PASS", name, "present"))
    if method.kind == "volume":
        return (F.when(compact(result).contains("표시량이상") | good, verdict("PASS", name, "volume"))
                .when(compact(result).contains("표시량미만") | bad, verdict("FAIL", name, "volume")))
    if method.kind == "endotoxin":
        return (F.when(compact(result).contains("초과") | bad, verdict("FAIL", name, "exceeds"))
                .when(good, verdict("PASS", name, "stated")))
    selected = compact(clean(criteria))
    counts = particle_counts(result)
    over = F.coalesce(counts["um10"] > method.low, F.lit(False)) | F.coalesce(counts["um25"] > method.high, F.lit(False))
    counted = counts["um10"].isNotNull() | counts["um25"].isNotNull()
    large = (F.when(over, verdict("FAIL", name, "count_exceeds")).when(counted, verdict("PASS", name, "count"))
             .when(good, verdict("PASS", name, "stated")).otherwise(verdict("HOLD", name, "count_unread")))
    return (F.when(bad | compact(result).contains("기준초과"), verdict("FAIL", name, "exceeds"))
            .when(contains_any(selected, _SMALL_CLASS), verdict("HOLD", name, "small_container"))
            .when(contains_any(selected, _LARGE_CLASS), large)
            .when(good, verdict("PASS", name, "stated")))


def method_verdict(record_text: Column, result: Column, criteria: Column, dated_text: Column) -> Column:
    """Verdict of the first matching method; null when no method applies or it cannot decide."""
    def judge(record_key: Column) -> Column:
        branch = None
        for method in METHODS:
            here = contains_any(record_key, list(method.wording))
            decision = _decide(method, clean(result), criteria, record_key, test_days(dated_text))
            branch = F.when(here, decision) if branch is None else branch.when(here, decision)
        return branch
    return let(compact(record_text), judge)
