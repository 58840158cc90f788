"""Acceptance criteria: range, comparison or exact value as one struct column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import capture, find_all, let, sub
from .measure import MEASUREMENT, NUMBER_AND_TAIL, measure_text, measured
from .text import clean

CRITERION = f"struct<kind:string,op:string,threshold:{MEASUREMENT},lower:{MEASUREMENT},upper:{MEASUREMENT}>"

_LIMIT_WORDS = "이하|미만|이상|초과"
_PLAIN = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
_UNIT = r"[A-Za-zμ%/²0-9\-.·]+(?:/[A-Za-zμ%/²0-9\-.·]+)?"
_RANGE = rf"({_PLAIN})\s*({_UNIT})?\s*~\s*({_PLAIN})\s*({_UNIT})?"


def criterion_text(text: Column) -> Column:
    flat = F.replace(F.replace(clean(text), F.lit("\\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    signs = F.translate(flat, "（）％µ×＞＜＝", "()%μx><=")
    signs = F.replace(F.replace(signs, F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<="))
    spaced = sub(signs, r"\s*(>=|<=|>|<)\s*", " $1 ")
    flat = F.trim(sub(spaced, r"\s+", " "))
    bracketed = sub(flat, rf"기준\s*\(([^)]+)\)\s*({_LIMIT_WORDS})", "$1 $2")
    return clean(sub(bracketed, rf"\(([0-9]+(?:\.[0-9]+)?(?:\s*[A-Za-zμ%/²0-9\-.·\[\]]*)?)\)\s*({_LIMIT_WORDS})", "$1 $2"))


def _quality(m: Column) -> Column:
    """-1 not usable (missing, or a count of repetitions/kinds), 0 without unit, 10 with unit."""
    return (F.when(m.isNull() | m["cunit"].isin("회", "종"), F.lit(-1))
            .when(m["cunit"] == "scalar", F.lit(0)).otherwise(F.lit(10)))


def _candidate(position: Column, preference: int, op: Column, m: Column) -> Column:
    return F.struct(_quality(m).alias("quality"), position.alias("position"),
                    F.lit(preference).alias("preference"), op.alias("op"), m.alias("m"))


def _best(candidates: Column) -> Column:
    """Unit first, then the latest position; null when none is usable."""
    return F.array_max(F.filter(candidates, lambda c: c["quality"] >= 0))


def _symbol_candidates(raw: Column) -> Column:
    pattern = r"(?s)(>=|<=|>|<)(?=(.*))"
    ops = find_all(raw, pattern, 1)
    return F.transform(find_all(raw, pattern, 2), lambda rest, i: let(
        measured(rest), lambda m: _candidate(F.length(raw) - F.length(rest), 1, F.get(ops, i), m)))


def _word_candidates(raw: Column) -> Column:
    pattern = rf"(?s)({_LIMIT_WORDS})(?=(.*))"
    words = find_all(raw, pattern, 1)

    def both_sides(rest: Column, i: Column) -> Column:
        word = F.get(words, i)
        op = (F.when(word == "이하", F.lit("<=")).when(word == "미만", F.lit("<"))
              .when(word == "이상", F.lit(">=")).otherwise(F.lit(">")))
        end = F.length(raw) - F.length(rest)
        before = F.try_element_at(find_all(F.substr(raw, F.lit(1), end - 2), NUMBER_AND_TAIL), F.lit(-1))
        return F.array(let(measured(before), lambda m: _candidate(end, 1, op, m)),
                       let(measured(rest), lambda m: _candidate(end, 0, op, m)))
    return F.flatten(F.transform(find_all(raw, pattern, 2), both_sides))


def _struct(kind: str, op: Column, threshold: Column, lower: Column, upper: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), op.cast("string").alias("op"), threshold.cast(MEASUREMENT).alias("threshold"),
                    lower.cast(MEASUREMENT).alias("lower"), upper.cast(MEASUREMENT).alias("upper"))


def criterion(text: Column) -> Column:
    """struct(kind, op, threshold, lower, upper); kind is range, compare, exact or unknown."""
    none = F.lit(None)

    def as_range(parts: Column) -> Column:
        unit = F.coalesce(F.nullif(F.get(parts, F.lit(4)), F.lit("")), F.get(parts, F.lit(2)))
        return _struct("range", none, none, measured(F.concat_ws(" ", F.get(parts, F.lit(1)), unit)),
                       measured(F.concat_ws(" ", F.get(parts, F.lit(3)), unit)))

    def as_compare(best: Column) -> Column:
        return _struct("compare", best["op"], best["m"], none, none)

    def as_exact(m: Column) -> Column:
        return (F.when(_quality(m) >= 0, _struct("exact", F.lit("=="), m, none, none))
                .otherwise(_struct("unknown", none, none, none, none)))

    def limits(raw: Column) -> Column:
        return let(_best(_symbol_candidates(raw)), lambda s: F.when(s.isNotNull(), as_compare(s)).otherwise(
            let(_best(_word_candidates(raw)), lambda w: F.when(w.isNotNull(), as_compare(w)).otherwise(
                let(measured(raw), as_exact)))))

    def parse(raw: Column) -> Column:
        return let(capture(raw, _RANGE, 4), lambda parts: F.when(parts.isNotNull(), as_range(parts)).otherwise(
            let(measure_text(raw), limits)))
    return let(criterion_text(text), parse)
