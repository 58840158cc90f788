"""Labelled fields inside a text block."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import capture, find_all, let, matches, sub


def _label_pattern(label: str) -> str:
    return r"\s*".join(re.escape(ch) for ch in label if not ch.isspace())


def logical_lines(text: Column) -> Column:
    """Lines with table continuation rows ('| | rest') joined to the line above."""
    return F.split(sub(F.coalesce(text, F.lit("")), r"\n(?=[ \t]*\|[ \t]*\|)", " "), "\n")


def field_values(text: Column, label: str) -> Column:
    """All values written for a label (spaced letters allowed), one per matching line."""
    pattern = rf"^[\s|]*{_label_pattern(label)}(?=$|[\s:：|\d])\s*[:：|]?\s*(.*)$"
    lines = F.filter(logical_lines(text), lambda line: matches(line, pattern))
    return F.transform(lines, lambda line: F.regexp_replace(sub(line, pattern, "$1"), r"^[ \t|]+|[ \t|]+$", ""))


def field_value(text: Column, label: str) -> Column:
    """The value of a label when it is written exactly once; ambiguity gives null."""
    value = let(field_values(text, label), lambda v: F.when(F.size(v) == 1, F.nullif(F.get(v, F.lit(0)), F.lit(""))))
    # most texts lack a letter of the label and need no pattern
    return F.when(reduce(lambda a, b: a & b, [text.contains(ch) for ch in dict.fromkeys(label) if not ch.isspace()], F.lit(True)), value)


def key_value(line: Column, labels: list[str], protected: list[str] = ()) -> Column:
    """struct(key, value): the longest known label that starts the line, else 'key: value' with a short key."""
    known = "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True))
    guarded = "|".join(re.escape(x) for x in protected) or r"(?!)"
    labelled = capture(line, rf"^({known})(?=[ :：])[ :：]*(.*)$", 2)
    plain = capture(line, r"^\s*([^:：]{1,40}?)\s*[:：]\s*(.+?)\s*$", 2)

    def as_struct(parts: Column) -> Column:
        return F.when(parts.isNotNull(), F.struct(F.trim(F.get(parts, F.lit(1))).alias("key"),
                                                  F.trim(F.get(parts, F.lit(2))).alias("value")))
    bullet = matches(line, r"^(?:[*†‡※⁕]|[-–—•·ㆍ①-⑩]\s*\S|\d+[)）]\s*\S)")
    bare = matches(line, rf"^(?:{known})$")
    return (F.when(matches(line, rf"^(?:{guarded})"), F.lit(None))
            .otherwise(F.coalesce(let(labelled, as_struct), F.when(~bullet & ~bare, let(plain, as_struct)))))


def numbers(text: Column) -> Column:
    """All plain numbers of a text as doubles, thousands separators removed."""
    return F.transform(find_all(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")), r"[-+]?\d+(?:\.\d+)?"),
                       lambda n: n.try_cast("double"))
