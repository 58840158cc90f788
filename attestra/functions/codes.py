"""Lot codes, quantities, statuses and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import capture, contains_any, find_all, let, literal_map, sub
from .text import clean, compact

# fixed values: quantity units written differently but counted alike
_QUANTITY_UNITS = {"l": "l", "ml": "ml", "ul": "ul", "kg": "kg", "g": "g", "dose": "dose", "doses": "dose",
                   "도즈": "dose", "병": "vial", "바이알": "vial", "vial": "vial", "vials": "vial", "개": "vial",
                   "ea": "vial", "": ""}

# fixed values: status wording
_FAIL_WORDS = ["부적합", "불합격", "fail"]
_PASS_WORDS = ["적합", "합격", "pass"]
_HOLD_WORDS = ["보류", "hold", "pending"]


def lot_code(text: Column) -> Column:
    return F.upper(sub(F.translate(clean(text), "－–—\n", "---"), r"[\s\-_/·.]+", ""))


def quantity(text: Column) -> Column:
    """struct(number, unit) with equal count units merged; null when the text is not one quantity."""
    flat = F.translate(F.replace(clean(text), F.lit(","), F.lit("")), "．Ｌｌℓ", ".LLL")
    flat = F.replace(F.replace(flat, F.lit("㎖"), F.lit("mL")), F.lit("㎕"), F.lit("uL"))
    units = "|".join(sorted((u for u in _QUANTITY_UNITS if u), key=len, reverse=True))

    def build(parts: Column) -> Column:
        plain = F.get(parts, F.lit(1)).try_cast("decimal(38,10)")
        number = F.regexp_replace(F.regexp_replace(plain.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        unit = F.try_element_at(literal_map(_QUANTITY_UNITS), F.lower(F.get(parts, F.lit(2))))
        return F.when(plain.isNotNull(), F.struct(number.alias("number"), unit.alias("unit")))
    return let(capture(flat, rf"^([0-9]+(?:\.[0-9]+)?)\s*((?i:{units}))?$", 2), build)


def bp_sizes(text: Column) -> Column:
    return F.transform(find_all(clean(text), r"(?i)([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\s*bp", 1),
                       lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("long"))


def particle_counts(text: Column) -> Column:
    """map size (10 or 25 µm) -> count per mL; the last statement of a size wins."""
    value = F.replace(F.replace(clean(text), F.lit("㎛"), F.lit("μm")), F.lit("um"), F.lit("μm"))
    size_first = r"(?i)(10|25)\s*μm\s*이상[^0-9]{0,20}(\d+(?:\.\d+)?)"
    count_first = r"(?i)(\d+(?:\.\d+)?)\s*(?:EA|개)\s*/?\s*(?:mL|vial)?[^0-9]{0,20}(10|25)\s*μm"

    def pairs(pattern: str, size: int, count: int) -> Column:
        counts = find_all(value, pattern, count)
        return F.transform(find_all(value, pattern, size), lambda s, i: F.struct(
            s.cast("int").alias("size"), F.get(counts, i).try_cast("double").alias("count")))

    def last_of(rows: Column) -> Column:
        def latest(size: int) -> Column:
            return F.try_element_at(F.filter(rows, lambda r: r["size"] == size), F.lit(-1))["count"]
        return F.struct(latest(10).alias("um10"), latest(25).alias("um25"))
    return let(F.concat(pairs(size_first, 1, 2), pairs(count_first, 2, 1)), last_of)


def status_word(text: Column, fallback: Column | None = None) -> Column:
    """PASS / FAIL / HOLD / N/A from Korean or English wording; the reason text decides when unclear."""
    def decide(value: Column) -> Column:
        low = F.lower(compact(value))
        return (F.when(low.isin("n/a", "na", "해당없음", "미해당"), "N/A")
                .when(contains_any(low, _FAIL_WORDS), "FAIL").when(contains_any(low, _HOLD_WORDS), "HOLD")
                .when(contains_any(low, _PASS_WORDS), "PASS"))
    first = decide(text)
    return F.coalesce(first, decide(fallback), F.lit("HOLD")) if fallback is not None else F.coalesce(first, F.lit("HOLD"))


def fingerprint(*parts: Column) -> Column:
    """Order-fixed digest of named parts; the separator cannot occur inside a part."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]), 256)
