"""Text clean-up, comparison keys and page/line classification."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import UNICODE, let, literal_map, matches, sub

# Compatibility blocks folded by the comparison key: Latin-1 signs, letter-like and
# number forms, enclosed forms, ideographic signs, squared units, half/full width.
_FOLD_RANGES = [(0xA0, 0xBE), (0x2070, 0x209C), (0x2100, 0x2188), (0x2460, 0x24EA),
                (0x3000, 0x3003), (0x3300, 0x33FF), (0xFB00, 0xFB06), (0xFF01, 0xFFEE)]


def _fold_table(ranges: list[tuple[int, int]]) -> dict[str, str]:
    table = {}
    for low, high in ranges:
        for code in range(low, high + 1):
            folded = unicodedata.normalize("NFKC", chr(code))
            if folded != chr(code):
                table[chr(code)] = folded
    return table


_KEY_FOLDS = _fold_table(_FOLD_RANGES)
_UNIT_FOLDS = _fold_table([(0x3300, 0x33FF)])


def _fold(text: Column, table: dict[str, str], guard: str) -> Column:
    """Replace listed characters by their (possibly longer) form; untouched rows skip the work."""
    lookup = literal_map(table)

    def spell(value: Column) -> Column:
        folded = F.array_join(F.transform(F.split(value, ""), lambda ch: F.coalesce(F.try_element_at(lookup, ch), ch)), "")
        return F.when(value.rlike(guard), folded).otherwise(value)
    return let(text, spell)


def clean(text: Column) -> Column:
    """One space between words, no blank lines, no outer white space; null becomes ''."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\u00a0\u3000\r", "  \n")
    joined = F.regexp_replace(F.regexp_replace(flat, "[ \t]+", " "), "\n{2,}", "\n")
    return F.regexp_replace(joined, UNICODE + r"^\s+|\s+$", "")


def fold_units(text: Column) -> Column:
    return _fold(text, _UNIT_FOLDS, "[\\u3300-\\u33ff]")


def key(text: Column) -> Column:
    """Comparison key: compatibility-folded, without white space, lower case."""
    guard = "[" + "".join(f"\\u{low:04x}-\\u{high:04x}" for low, high in _FOLD_RANGES) + "]"
    folded = _fold(F.coalesce(text, F.lit("")), _KEY_FOLDS, guard)
    return F.lower(sub(folded, r"\s+", ""))


def compact(text: Column) -> Column:
    return sub(F.coalesce(text, F.lit("")), r"\s+", "")


def meaning(text: Column) -> Column:
    """Compact lower-case form without separators, used by the qualitative lexicon."""
    plain = F.translate(F.replace(F.lower(clean(text)), F.lit("e.coli"), F.lit("ecoli")), "％µ", "%μ")
    return sub(plain, r"[\s\-_·.,:：/(){}\[\]]+", "")


def join_decimals(text: Column) -> Column:
    return sub(text, r"(?<=\d)\s*\.\s*(?=\d)", ".")


def scientific(text: Column) -> Column:
    """'4.26 x 10 6' and superscript powers become '4.26 x 10^6'."""
    plain = F.translate(text, "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
    powered = sub(plain, r"(\d+(?:\.\d+)?)\s*[xX×]\s*10\s*(\d{1,2})(?![\d^])", "$1 x 10^$2")
    return sub(powered, r"(10\^\d+)(?=[A-Za-z가-힣])", "$1 ")


def search_form(text: Column) -> Column:
    """Normal form used before retrieval: unit glyphs spelled out, doubled aliases added."""
    glyphs = F.translate(clean(text), "µμ·⋅∙⁻−²³¹", "uu...--231")
    # fixed values: multi-letter glyph spellings
    spelled = {"Å": "Ao", "℃": "°C", "㎍": "ug", "㎎": "mg", "㎖": "mL", "㎕": "uL", "㎛": "um"}
    for glyph, plain in spelled.items():
        glyphs = F.replace(glyphs, F.lit(glyph), F.lit(plain))
    return clean(F.replace(glyphs, F.lit("mmHg"), F.lit("mm[Hg] mmHg")))


def is_page_furniture(line: Column) -> Column:
    """Printed page numbers and lone punctuation."""
    return matches(line, r"^(?:|[:：]|--?|-?\s*\d+\s*-?|\d+\s*/\s*\d+(?:\s*페이지)?|\d+\.|:?\s*페이지)$")


def is_leader(line: Column) -> Column:
    return matches(line, r"^(?:[_\-.·\s]{3,}|[_\-.·]{2})$")


def is_reviewer_comment(line: Column) -> Column:
    # fixed values: reviewer-comment wording in the source documents
    hints = ["부탁드립니다", "이미지표시", "오른쪽 마우스", "해당 시험은 최소", "소요되는 로직",
             "최소 28일 소요", "최소 21일", "소요됨"]
    labelled = matches(line, r"^(?:시험방법|시험기준|시험기간|시험결과|시험일자)\b")
    hinted = F.lit(False)
    for hint in hints:
        hinted = hinted | line.contains(hint)
    return (line.contains("메모") & matches(line, r"메모\s*포함\s*\[/최\d+(?:R\d+)?\]\s*:")) | (hinted & ~labelled)


def strip_leaders(line: Column) -> Column:
    trimmed = sub(line, r"^\s*(?:_{3,}|[-–—.·_]{5,})\s*(?=\S)", "")
    # every text that ends with leaders ends with three of their characters
    cut = lambda x: F.when(matches(x, r"[-–—.·_]{3}\s*$"), sub(x, r"(?<=\S)\s*(?:_{3,}|[-–—.·_]{5,})\s*$", "")).otherwise(x)
    return F.trim(let(trimmed, cut))


# fixed values: titles that look like headings but are values, units or requirement endings
_NOT_A_TITLE = (
    r"^(?:이하|이상|적합|부적합|페이지)$|^%|^[\d.\-~/\s%]+$"
    r"|\b(?:mL|ml|mg|kg|g|IU|CFU|PFU|%)\b|[xX×]\s*10\s*\^?\s*[\d⁰¹²³⁴⁵⁶⁷⁸⁹]"
    r"|(?:CFU|PFU|cells|EU|μg|ng|mg|ml|mL|nm)\s*/\s*(?:mL|ml|L|kg|mg|g|dose|vial|protein)"
    r"|(?:이상이어야|이하이어야|이상\s*|이하\s*|미만\s*|초과\s*)$"
    r"|(?:이어야|되어야|않아야|하여야|해야|한다\.?$)|^(?:[xX×]\s*10|[%℃~±])"
)
# A dotted number, or one number followed by a short title.
_NUMBERED = (r"^(?:\d+(?:\.\d+)+(?=\s+[가-힣A-Za-z(]|[가-힣]|\s*[.)]\s+\S)"
             r"|\d+(?=\.\s+[가-힣A-Za-z(]|\s+[가-힣A-Za-z(].{0,30}$))")
_UNIT_LED = r"^\d+\s*(?:μg|ug|mg|g|kg|mL|ml|L|IU|CFU|PFU|%|ppm|ppb|℃|°C)\b"


def heading(line: Column) -> Column:
    """struct(number, title, depth) for a numbered section heading, else null."""
    body = join_decimals(line)
    number = F.regexp_extract(body, UNICODE + _NUMBERED, 0)
    title = F.trim(sub(body, r"^\d+(?:\.\d+)*[\s.)：:]*", ""))
    zero_part = number.rlike(r"(^|\.)0+(\.|$)")
    valid = (number != "") & (title != "") & ~zero_part & ~matches(body, _UNIT_LED) & ~matches(title, _NOT_A_TITLE)
    return F.when(valid, F.struct(number.alias("number"), title.alias("title"),
                                  F.size(F.split(number, r"\.")).alias("depth")))


# fixed values: recurrent mis-decoded syllables
_MOJIBAKE = r"\x{FFFD}{2,}|[ÃÂâ]\S{1,3}"


def looks_corrupt(text: Column, mojibake: str = _MOJIBAKE) -> Column:
    """Page text that cannot be the native text of a Korean document."""
    def check(value: Column) -> Column:
        foreign = F.length(F.regexp_replace(value, r"[\u0000-\u007f]|[^\p{L}]", ""))
        hangul = F.length(F.regexp_replace(value, "[^가-힣]", ""))
        broken = F.length(F.regexp_replace(value, r"[^\x{FFFD}]", ""))
        return ((F.length(value) == 0) | (broken >= F.lit(0.03) * F.length(value)) | value.rlike(mojibake)
                | ((foreign >= 8) & (hangul < F.lit(0.12) * foreign)))
    return let(clean(text), check)


def choose_page_text(native: Column, scanned: Column) -> Column:
    """struct(text, source): native text, else a usable scanned text, else unreadable."""
    usable = F.coalesce(scanned, F.lit("")).rlike("[가-힣]") & ~looks_corrupt(scanned)
    return (F.when(~looks_corrupt(native), F.struct(clean(native).alias("text"), F.lit("native").alias("source")))
            .when(usable, F.struct(clean(scanned).alias("text"), F.lit("scan").alias("source")))
            .otherwise(F.struct(F.lit("").alias("text"), F.lit("unreadable").alias("source"))))
