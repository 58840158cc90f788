"""Overlaps of character ranges as an equality join over bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_CHARS = 2048


def _bins(low: Column, high: Column, size: int) -> tuple[Column, Column]:
    """First and last bin that a half-open range touches."""
    return F.floor(low / size).cast("bigint"), F.floor(F.greatest(low, high - 1) / size).cast("bigint")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], ends: tuple[str, str], other_ends: tuple[str, str], size: int = BIN_CHARS) -> DataFrame:
    """All pairs of rows of equal keys whose ranges overlap, once each.

    A range stands in every bin that it touches, so a long one costs a row per bin and no key is compared with itself all to all.
    A pair counts in the later of its two first bins alone. Rows with a null key or end meet nothing.
    Apart from the keys the two tables need different column names.
    """
    def binned(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
        first, last = _bins(F.col(low), F.col(high), size)
        sound = df.where(F.col(low).isNotNull() & (F.col(high) >= F.col(low)))
        return sound.withColumn(name, first).withColumn("_bin", F.explode(F.sequence(first, last)))
    # rows per bin are many times the files by which the optimizer would broadcast them
    pairs = binned(left, *ends, "_first").hint("merge").join(binned(right, *other_ends, "_other"), [*keys, "_bin"])
    met = (F.col("_bin") == F.greatest("_first", "_other")) & (F.col(other_ends[0]) < F.col(ends[1])) & (F.col(other_ends[1]) > F.col(ends[0]))
    return pairs.where(met).drop("_bin", "_first", "_other")


def owning_spans(hits: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Hits with the spans they lie in: node_ids and span_ids in page order without repeats, and owned.

    hits: keys, term, char_start, char_end; spans: keys, node_id, span_id, span_start, span_end. A hit that no span overlaps has
    empty lists and owned = false: its wording stands in no section and has to be looked at.
    """
    place = [*keys, "term", "char_start", "char_end"]
    span = F.struct("span_start", "span_end", "span_id", "node_id")
    found = overlaps(hits.select(*place).distinct(), spans.select(*keys, "node_id", "span_id", "span_start", "span_end"), keys, ("char_start", "char_end"), ("span_start", "span_end"))
    lists = found.groupBy(*place).agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    joined = hits.hint("merge").join(lists, place, "left")
    ids = lambda name, kind: F.coalesce(F.array_distinct(F.transform("_spans", lambda s: s[name])), F.array().cast(f"array<{kind}>"))
    kinds = {name: spans.schema[name].dataType.simpleString() for name in ("node_id", "span_id")}
    return joined.withColumns({"node_ids": ids("node_id", kinds["node_id"]), "span_ids": ids("span_id", kinds["span_id"]), "owned": F.col("_spans").isNotNull()}).drop("_spans")
