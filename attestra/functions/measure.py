"""Measurements: number, power of ten and unit as one struct column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import capture, let, literal_map, sub
from .text import clean, fold_units

MEASUREMENT = "struct<value:double,unit:string,cvalue:double,cunit:string>"

# Accepted unit spellings (white space removed) and their canonical unit.
UNITS = {
    "%": "fraction",
    "mL": "mL", "ml": "mL", "ML": "mL", "L": "L",
    "mg": "mg", "g": "g", "kg": "kg", "μg": "μg", "ug": "μg", "ng": "ng",
    "μg/mL": "μg/mL", "ug/mL": "μg/mL", "mg/mL": "mg/mL", "ng/mL": "ng/mL",
    "μg/mgofprotein": "μg/mg of protein", "ug/mgofprotein": "μg/mg of protein",
    "ng/mgofprotein": "ng/mg of protein",
    "EU/mL": "EU/mL", "EU/ml": "EU/mL", "EU/dose": "EU/dose", "EU/mgofprotein": "EU/mg of protein",
    "IU/mL": "IU/mL", "IU/ml": "IU/mL",
    "CFU/mL": "CFU/mL", "CFU/ml": "CFU/mL", "CFU/10mL": "CFU/10mL", "CFU/10ml": "CFU/10mL",
    "cells/mL": "cells/mL", "cell/mL": "cells/mL", "cells/ml": "cells/mL", "cell/ml": "cells/mL",
    "mOsm/kg": "mOsm/kg", "mOsmol": "mOsmol", "nm": "nm", "Da": "Da", "kDa": "kDa",
    "개": "count", "개/vial": "count_per_vial",
}
_KNOWN = "^(" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")"

_POWER = r"\s*[xX×]\s*10\s*(?:\^\s*)?"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺"
NUMBER = r"[+-]?\d[\d,]*(?:\.\d+)?"
_MEASURE = rf"({NUMBER})(?:{_POWER}([+\-]?\d+|[{SUPERSCRIPTS}]+))?(.*)"
# A number with its power, and the text up to the next number.
NUMBER_AND_TAIL = rf"{NUMBER}(?:{_POWER}[+\-]?[\d{SUPERSCRIPTS}]+)?[^\d]*"
_EDGE = r"^[ :：,;()\[\]{}]+|[ :：,;()\[\]{}]+$"


# Words that end the unit behind a number.
ENDS_UNIT = ["이상", "이하", "초과", "미만", "이어야", "하여야", "함", "일치", "확인", "무", "음성", "양성", "불검출", "검출"]


def measure_text(text: Column) -> Column:
    """Unit glyphs and sign variants folded; superscripts keep their meaning."""
    plain = F.translate(fold_units(clean(text)), "µ％×", "μ%x")
    return sub(plain, r"(?<=[A-Za-zμ])\s*/\s*(?=[A-Za-zμ])", "/")


def _unit_struct(value: Column, tail: Column) -> Column:
    cut = sub(tail, r"(?s)\s*(?:" + "|".join(ENDS_UNIT) + r")\b.*$", "")
    edge = F.regexp_replace(cut, _EDGE, "")

    def with_edge(text: Column) -> Column:
        known = F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), _KNOWN, 1)
        first = F.regexp_replace(F.regexp_extract(text, r"^(\S*)", 1), _EDGE, "")
        unit = F.when(known != "", known).otherwise(first)

        def with_unit(u: Column) -> Column:
            canonical = F.coalesce(F.try_element_at(literal_map(UNITS), u), F.when(u == "", F.lit("scalar")), u)
            return F.struct(value.alias("value"), u.alias("unit"),
                            F.when(u == "%", value / 100.0).otherwise(value).alias("cvalue"),
                            canonical.alias("cunit"))
        return let(unit, with_unit)
    return let(edge, with_edge)


def measurement(text: Column) -> Column:
    """First number of a text with its unit (null when the text holds no number)."""
    return measured(measure_text(text))


def measured(normal: Column) -> Column:
    """`measurement` of a text that is in its normal form already."""
    def build(parts: Column) -> Column:
        base = F.replace(F.get(parts, F.lit(1)), F.lit(","), F.lit("")).try_cast("double")
        power = F.translate(F.get(parts, F.lit(2)), SUPERSCRIPTS, "0123456789-+").try_cast("int")
        value = F.when(power.isNull(), base).otherwise(base * F.pow(F.lit(10.0), power))
        return F.when(base.isNotNull(), let(value, lambda v: _unit_struct(v, F.get(parts, F.lit(3)))))
    return let(capture(normal, _MEASURE, 3), build)


def comparable(a: Column, b: Column) -> Column:
    """Same canonical unit, or one side without a unit."""
    return (a["cunit"] == b["cunit"]) | (a["cunit"] == "scalar") | (b["cunit"] == "scalar")


def compare(left: Column, op: Column, right: Column) -> Column:
    return (F.when(op == "<=", left <= right).when(op == "<", left < right)
            .when(op == ">=", left >= right).when(op == ">", left > right)
            .when(op == "==", left == right))
