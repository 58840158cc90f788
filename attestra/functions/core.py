"""Small building blocks for expressions that are parsed once and used many times."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware classes (\w, \s, \d, \b) in every pattern of the package.
UNICODE = "(?U)"
MARK = "\u0001"


def free_of_mark(text: Column) -> Column:
    """The text with its own marks written as two control characters, so that MARK can cut it; `with_mark` undoes it."""
    return F.replace(F.replace(text, F.lit("\u0002"), F.lit("\u0002\u0004")), F.lit(MARK), F.lit("\u0002\u0005"))


def with_mark(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\u0002\u0005"), F.lit(MARK)), F.lit("\u0002\u0004"), F.lit("\u0002"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def capture(text: Column, pattern: str, groups: int) -> Column:
    """All groups of the first match in one regex pass: element i is group i; null without a match."""
    whole = F.regexp_replace(
        text, f"(?Us)^.*?(?:{pattern}).*$", MARK + MARK.join(f"${i}" for i in range(1, groups + 1))
    )
    return let(F.split(whole, MARK), lambda parts: F.when(F.size(parts) == groups + 1, parts))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(UNICODE + pattern), F.lit(group))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(UNICODE + pattern)


def sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, UNICODE + pattern, replacement)


def contains_any(text: Column, markers: list[str]) -> Column:
    """True when one of the literal markers occurs in the text."""
    return text.rlike("|".join(re.escape(m) for m in markers)) if markers else F.lit(False)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def literal_map(table: dict[str, str]) -> Column:
    """A constant map built from one string literal, so that large tables keep plans small."""
    packed = "\u0002".join(f"{key}\u0003{value}" for key, value in table.items())
    return F.str_to_map(F.lit(packed), F.lit("\u0002"), F.lit("\u0003"))
