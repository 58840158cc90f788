"""Substring deduplication by sliding sentence spans.

Every run of consecutive sentences is hashed: from each sentence on, the shortest run of at least `min_sentences`
sentences and `min_words` words, and likewise back from the end of each line or of every sentence. Hashes are joined over the whole corpus; every run but the first of its hash covers
its sentences, and covered sentences are removed. A sentence ends at a stop mark or a line break; every one is
cut further behind words chosen by their own hash, and CUT_AFTER words behind such a cut at the latest, so a passage is
cut alike wherever it stands, also if its ends share a sentence with other text.

The first pass over the texts shuffles the hashes alone and marks those that occur twice in a bitmap of fixed size. The
second pass only emits runs whose hash is marked, with 64 further bits, so most texts send nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tabled, text_of

CUT_EVERY_BITS = 3
CUT_AFTER = 16
# Texts tokenised at once, at most so many or so long.
TEXTS = 64
CHARS = 1 << 20
# Bits of a bitmap: what is not marked there is surely not wanted; a fuller one lets more pass, never less.
MARKS = 1 << 25
# Odd multipliers of two hashes; run hashes are differences of one prefix sum, taken back to the start by the inverse.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xA0761D6478BD642F)
    return x ^ x >> np.uint64(32)


def _sliding(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Mixed polynomial hash of values[start:end], the same wherever equal values stand."""
    n = len(values)
    powers, inverse = np.full(n + 1, base, dtype=np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
    powers[0] = inverse[0] = 1
    powers, inverse = np.cumprod(powers), np.cumprod(inverse)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:n], dtype=np.uint64)])
    return _mix((prefix[end] - prefix[start]) * inverse[start])


@dataclass(frozen=True)
class Tokens:
    """Words of several texts with the sentences they form.

    first and last: code points of a word among all texts, written one after the other with a character between; text: the text of each
    word; lines: words that end a line or a text; sentence: first word of every sentence, and the number of words at the end;
    offsets: where each text begins; characters: lower-cased code points.
    """
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    lines: np.ndarray
    sentence: np.ndarray
    offsets: np.ndarray
    characters: np.ndarray

    def hashes(self, base: int) -> np.ndarray:
        return _sliding(self.characters, self.first, self.last + 1, base)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points in its own text from which and up to which each sentence reaches, white space behind it included."""
        starts, of = self.first[self.sentence[:-1]], self.text[self.sentence[:-1]]
        if not len(starts):
            return starts, starts
        begins = np.r_[True, of[1:] != of[:-1]]
        ends = np.r_[starts[1:], 0]
        lasting = np.r_[begins[1:], True]
        ends[lasting] = self.offsets[of[lasting] + 1] - 1
        starts = np.where(begins, self.offsets[of], starts)
        return starts - self.offsets[of], ends - self.offsets[of]


def tokens(texts: list[str]) -> Tokens:
    """Words end at white space and behind stop marks; letter case does not count."""
    whole = "\n".join(texts)
    low = whole.lower()
    if len(low) != len(whole):
        low = "".join(c.lower()[:1] for c in whole)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    body = ~_SPACE[np.minimum(points, len(_SPACE) - 1)]
    stop = (points == ord(".")) | (points == ord("!")) | (points == ord("?"))
    before = np.r_[False, body[:-1]] & ~(np.r_[False, stop[:-1]] & ~stop)
    begins = body & ~before
    first = np.flatnonzero(begins)
    last = np.flatnonzero(body & ~np.r_[body[1:] & ~begins[1:], False])
    text = np.searchsorted(offsets, first, side="right") - 1
    made = Tokens(first, last, text, first, first, offsets, points.astype(np.uint64) + np.uint64(1))
    n = len(first)
    if not n:
        return Tokens(first, last, text, np.zeros(0, bool), np.zeros(1, dtype=np.int64), offsets, made.characters)
    gap = np.r_[first[1:], len(points)]
    breaks = np.concatenate([[0], np.cumsum(points == ord("\n"))])
    lines = (breaks[gap] > breaks[last + 1]) | np.r_[text[1:] != text[:-1], True]
    chosen = made.hashes(BASES[0]) >> np.uint64(64 - CUT_EVERY_BITS) == 0
    cut = lines | stop[last] | chosen
    place = np.arange(n)
    since = place - np.maximum.accumulate(np.r_[-1, np.where(cut, place, -1)[:-1]])
    cut |= since % CUT_AFTER == 0
    return Tokens(first, last, text, lines, np.r_[0, np.flatnonzero(cut) + 1], offsets, made.characters)


def sentences(text: str) -> list[str]:
    """Pieces whose concatenation is the text."""
    return [text[a:b] for a, b in zip(*tokens([text]).edges())]


@dataclass(frozen=True)
class Runs:
    """Per run its hash, its text, and the range of code points there as start << 32 | length."""
    h: np.ndarray
    text: np.ndarray
    place: np.ndarray
    start: np.ndarray
    end: np.ndarray


def runs(found: Tokens, min_sentences: int, min_words: int, every_end: bool = False) -> Runs:
    """The shortest runs from every sentence on and back from the ends; start and end are places of words."""
    edge, n = found.sentence, len(found.sentence) - 1
    first = np.arange(n)
    end = np.maximum(np.searchsorted(edge, edge[:-1] + min_words), first + min_sentences)
    close = first + 1 if every_end else first[found.lines[edge[1:] - 1]] + 1
    back = np.minimum(np.searchsorted(edge, edge[close] - min_words, side="right") - 1, close - min_sentences)
    close, back = close[back >= 0], back[back >= 0]
    new = end[back] != close
    first, end = first[end <= n], end[end <= n]
    first, end = np.concatenate([first, back[new]]), np.concatenate([end, close[new]])
    text = found.text[edge[:-1]]
    inside = text[first] == text[end - 1]
    first, end = first[inside], end[inside]
    low, high = found.edges()
    low, high = low[first], high[end - 1]
    start, end = edge[first], edge[end]
    return Runs(_sliding(found.hashes(BASES[0]), start, end, BASES[0]).view(np.int64), text[first], low << 32 | high - low, start, end)


def further(found: Tokens, picked: Runs) -> np.ndarray:
    """Another 64 bits of every run, from other hashes of its words."""
    return _sliding(found.hashes(BASES[1]), picked.start, picked.end, BASES[1]).view(np.int64)


def batched(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Parts of the texts and where each begins."""
    at = size = 0
    for k, text in enumerate(texts):
        if k > at and (k - at >= TEXTS or size + len(text) > CHARS):
            yield at, texts[at:k]
            at, size = k, 0
        size += len(text)
    if texts:
        yield at, texts[at:]


def bitmap(df: DataFrame, name: str) -> np.ndarray:
    """MARKS bits, two of them set for every value of a column of mixed longs; built by one aggregate, of fixed size on the driver."""
    spot = lambda v: v.bitwiseAND(F.lit(MARKS - 1))
    spots = df.select(F.explode(F.array(spot(F.col(name)), spot(F.shiftrightunsigned(name, 32)))).alias("p"))
    words = spots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(MARKS >> 6, dtype=np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bits of each value are set."""
    values, low = np.asarray(values, dtype=np.int64).view(np.uint64), np.uint64(64 * len(bits) - 1)
    spots = [values & low, values >> np.uint64(32) & low]
    return np.logical_and.reduce([bits[s >> np.uint64(6)] >> (s & np.uint64(63)) & np.uint64(1) == 1 for s in spots])


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_sentences: int = 2, min_words: int = 16,
                    every_end: bool = False) -> DataFrame:
    """The rows of docs, their text without repeated runs, and `removed_spans`: code point ranges of the text before.

    The first run of a hash is the one with the smallest key (nulls first), then row, then place. Rows equal in key
    and text count as one document and are treated alike. Null and empty texts have no sentence and stay as they are; texts of
    fewer words than `min_words` or fewer sentences than `min_sentences` have no run and stay. Runs go back from line and
    text ends, with `every_end` from the end of every sentence, so a repeated passage that text of the same line follows
    goes whole. Other columns are
    kept, whatever their names; an input column named `removed_spans` is replaced. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("removed_spans")
    kind = docs.schema[key].dataType.simpleString()
    # all columns travel in one, so none of them can clash with these
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("rid"))
    texts = rows.select("key", "rid", text_of("text").alias("text")).where("text <> ''")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in batched(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(runs(tokens(part), min_sentences, min_words, every_end).h)], ["h"])

    twice = texts.select("text").mapInArrow(hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = bitmap(twice, "h")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in batched(batch.column("text").to_pylist()):
                found = tokens(part)
                all_ = runs(found, min_sentences, min_words, every_end)
                keep = np.flatnonzero(marked(repeats, all_.h))
                if len(keep):
                    picked = Runs(*[a[keep] for a in (all_.h, all_.text, all_.place, all_.start, all_.end)])
                    row = pa.array(picked.text + at)
                    yield pa.RecordBatch.from_arrays([pa.array(picked.h), pa.array(further(found, picked)), batch.column("rid").take(row), pa.array(picked.place), batch.column("key").take(row)],
                                                     ["h", "other", "rid", "place", "key"])

    spans = tabled(texts.mapInArrow(emit, f"h long, other long, rid long, place long, key {kind}"))
    first = spans.groupBy("h", "other").agg(F.min(F.struct("key", "rid", "place")).alias("first"))
    later = spans.join(first, ["h", "other"]).where("rid <> first.rid or place <> first.place or not (key <=> first.key)")
    covered = tabled(later.groupBy("rid", "key").agg(F.collect_set("place").alias("places")))
    touched = bitmap(covered, "rid")

    @F.pandas_udf("boolean")
    def may(rid: pd.Series) -> pd.Series:
        return pd.Series(marked(touched, rid.to_numpy()))

    ranges = "array<struct<start:int,end:int>>"

    @F.pandas_udf(f"text string, spans {ranges}")
    def cut(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_without(t, p) for t, p in zip(texts, places)], columns=["text", "spans"])

    # a text travels once, inside its row
    own = F.col("row").getField(text)

    def back(df: DataFrame, new: Column, spans: Column) -> DataFrame:
        return df.select(*[(new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns], spans.alias("removed_spans"))

    none = F.array().cast(ranges)
    # rows that surely lose nothing meet no exchange
    same = back(rows.where(~may("rid")), own, none)
    met = rows.where(may("rid")).alias("d").join(covered.alias("c"), F.expr("d.rid = c.rid and d.key <=> c.key"), "left").select("row", "places")
    losing = met.where("places is not null").withColumn("cut", cut(own, "places"))
    kept = back(met.where("places is null"), own, none)
    return back(losing, F.col("cut.text"), F.col("cut.spans")).unionByName(kept).unionByName(same)


def _without(text: str, places: np.ndarray) -> tuple[str, list[dict]]:
    """The text without the union of some ranges, and the ranges of that union."""
    spans: list[dict] = []
    for start, size in sorted((int(p) >> 32, int(p) & 0xFFFFFFFF) for p in places):
        if spans and start <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], start + size)
        else:
            spans.append({"start": start, "end": start + size})
    edges = [0, *[e for s in spans for e in (s["start"], s["end"])], len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), spans
