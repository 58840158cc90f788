"""Document fingerprints by a randomised edit embedding.

A walk reads the text: at each step it writes the current character and moves on if a random bit, shared by all
documents, says so for this step and character. Texts within a small edit distance walk in step again after an edit, so their
written strings differ in few places. The fingerprint holds one random bit of the character written at each of BITS
places, which a shared random order picks from the whole length; its Hamming distance estimates the edit distance.
Bands of sampled bits find near fingerprints, and whole fingerprints verify them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, range_index, restored, small_batches, splitters, stored, text_of
from .components import components

BITS = 512
CLASSES = 256
PERIOD = 256
LONGEST = 1 << 40
# Text bytes of a range of documents in key order, and ranges at most: their bounds are part of the plan.
RANGE_BYTES = 4 << 20
MOST_RANGES = 20_000
# At a likeness of 0.8 a band agrees in one case of four or five, and one of all bands nearly always.
BANDS = 24
BAND_BITS = 14
TILE_ROWS = 2048

_random = np.random.default_rng(20240607)
_moves = _random.random((CLASSES, PERIOD)) < 0.5
_moves[:, -1] = True
# Where the walk stands (modulo the period) after the character of a class that it began to write there.
NEXT = [bytes((p + 1 + int(np.argmax(np.roll(row, -p)))) % PERIOD for p in range(PERIOD)) for row in _moves]
BIT = _random.integers(0, 2, (BITS, CLASSES), dtype=np.uint8)


def _records() -> np.ndarray:
    """Per bit the places where a shared random order over all places has a new minimum; the last one below a length is its place."""
    rows = []
    for _ in range(BITS):
        at, low, places = 0, _random.random(), []
        while at < LONGEST:
            places.append(at)
            at += int(min(_random.geometric(low), LONGEST))
            low *= _random.random()
        rows.append(places)
    wide = max(map(len, rows))
    return np.array([r + [LONGEST * 4] * (wide - len(r)) for r in rows], dtype=np.int64)


RECORDS = _records()
SLOTS = np.arange(BITS)


def classes(text: str) -> bytes:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def walk(kinds: bytes, start: int = 0) -> bytes:
    """The standing before the first and after each character."""
    return bytes(accumulate(map(NEXT.__getitem__, kinds), lambda at, row: row[at], initial=start))


def sampled(kinds: bytes, standing: bytes) -> np.ndarray:
    """The packed bits of a walk; all zero for the empty text."""
    if not kinds:
        return np.zeros(BITS // 8, dtype=np.uint8)
    at = np.frombuffer(standing, dtype=np.uint8)
    ends = np.cumsum((at[1:] - at[:-1] - np.uint8(1)).astype(np.int64) + 1)
    places = RECORDS[SLOTS, (RECORDS < ends[-1]).sum(axis=1) - 1]
    written = np.frombuffer(kinds, dtype=np.uint8)[np.searchsorted(ends, places, side="right")]
    return np.packbits(BIT[SLOTS, written])


def fingerprint(text: str) -> np.ndarray:
    kinds = classes(text)
    return sampled(kinds, walk(kinds))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bits beyond what chance gives: 1 for equal fingerprints, about 0 for unrelated ones."""
    return max(0.0, 1.0 - 2.0 * int(np.bitwise_count(a ^ b).sum()) / BITS)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (_range, _tail, _key, _hash, _text), sorted inside partitions by the first four.

    Rows of a range are in ascending order of key (nulls first), then of the text's hash; a range ends with a copy of the row
    that follows it (`_tail`), the last one with the first row of all. Ranges have about equal bytes.
    """
    rows = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    sizes = stored(rows.select("_key", "_hash", (F.octet_length("_text").cast("long") + 16).alias("_size"), F.monotonically_increasing_id().alias("_id")))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    bounds = splitters(sizes.where("_key is not null"), "_key", "_size", "_id", total, min(MOST_RANGES, -(-total // RANGE_BYTES)))
    place = range_index(F.col("_key"), bounds).cast("int")
    firsts = sizes.groupBy(place.alias("_range")).agg(F.min(F.struct("_key", "_hash")).alias("first"))
    order = Window.orderBy("_range")
    last = F.max("_range").over(Window.partitionBy())
    # One row per range at most.
    firsts = firsts.select("first.*", F.coalesce(F.lag("_range").over(order), last).alias("_to")).withColumnsRenamed({"_key": "k", "_hash": "h"})
    met = rows.join(F.broadcast(firsts), F.col("_key").eqNullSafe(F.col("k")) & (F.col("_hash") == F.col("h")), "left")
    own = F.struct(place.alias("_range"), F.lit(False).alias("_tail"))
    copy = F.struct(F.col("_to").alias("_range"), F.lit(True).alias("_tail"))
    spread = met.select("_key", "_hash", "_text", F.inline(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    return spread.repartition("_range").sortWithinPartitions("_range", "_tail", "_key", "_hash")


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; other columns are dropped.

    The edited text has its last half (rounded down) replaced by as much of the start of the next document in key order; the
    last document is followed by the first. Null texts count as empty; rows of equal keys follow in the order of a hash of
    their texts, null keys come first. A single row follows itself. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            out = []
            for place, tail, key_, text_ in zip(batch["_range"], batch["_tail"], batch["_key"], batch["_text"]):
                if tail and waiting is None:
                    continue
                kinds = classes(text_)
                standing = walk(kinds)
                print_ = sampled(kinds, standing)
                if waiting is not None:
                    old_key, old, old_kinds, old_standing, old_print = waiting
                    keep = len(old) - len(old) // 2
                    edited = old[:keep] + text_[:len(old) // 2]
                    more = kinds[:len(old) // 2]
                    new = sampled(old_kinds[:keep] + more, old_standing[:keep] + walk(more, old_standing[keep]))
                    out.append((old_key, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), old_print.tobytes().hex(),
                                new.tobytes().hex(), likeness(old_print, new), likeness(old_print, print_)))
                waiting = None if tail else (key_, text_, kinds, standing, print_)
            yield pd.DataFrame(out, columns=names)

    schema = "key string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = with_next(docs, key, text).withColumn("_key", carried("_key"))
    return rows.mapInPandas(read, schema).select(restored(docs, key, "key").alias(key), *names[1:])


def _bands(raw: np.ndarray) -> np.ndarray:
    """One value per band from its own sample of bits."""
    chosen = np.stack([np.random.default_rng(k).choice(BITS, BAND_BITS, replace=False) for k in range(BANDS)])
    bits = np.unpackbits(raw, axis=1)[:, chosen]
    return bits.astype(np.int64) @ (1 << np.arange(BAND_BITS, dtype=np.int64)) + (np.arange(BANDS, dtype=np.int64) << BAND_BITS)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """Key, fingerprint and class_id, the smallest key reachable over fingerprints of at least that likeness.

    Distinct fingerprints meet in bands of sampled bits; a crowded band is compared tile by tile. Null texts count as
    empty; repeated rows stay. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    most = int((1.0 - least) / 2.0 * BITS + 1e-9)

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t).tobytes())

    @F.pandas_udf("array<long>")
    def bands(prints: pd.Series) -> pd.Series:
        return pd.Series(list(_bands(np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(-1, BITS // 8))))

    rows = stored(docs.select(F.col(key).alias("_key"), of(text_of(text)).alias("print")))
    distinct = stored(rows.groupBy("print").agg(F.min("_key").alias("first")).withColumn("node", F.xxhash64("print")))
    each = distinct.select("node", "print", F.explode(bands("print")).alias("band"))
    sizes = each.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).alias("n"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    tiles = stored(each.join(sizes, "band").groupBy("band", F.pmod(F.col("node"), "n").alias("tile")).agg(F.collect_list(F.struct("node", "print")).alias("held")))
    right = tiles.select("band", F.col("tile").alias("other"), F.col("held").alias("there"))
    pairs = tiles.join(right, "band").where("tile <= other").select("held", "there")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for held, there in zip(batch["held"], batch["there"]):
                left, right = ([np.frombuffer(x["print"], dtype=np.uint64) for x in side] for side in (held, there))
                left, right = np.stack(left), np.stack(right)
                a, b = np.array([x["node"] for x in held]), np.array([x["node"] for x in there])
                name = {int(n): int(n) for n in np.concatenate([a, b])}

                def top(n: int) -> int:
                    while name[n] != n:
                        name[n] = n = name[name[n]]
                    return n

                for k in range(len(left)):
                    for m in np.flatnonzero(np.bitwise_count(left[k] ^ right).sum(axis=1) <= most):
                        x, y = top(int(a[k])), top(int(b[m]))
                        name[max(x, y)] = min(x, y)
                joined = [(n, top(n)) for n in name if top(n) != n]
                yield pd.DataFrame(joined, columns=["a", "b"], dtype=np.int64)

    labels = components(pairs.mapInPandas(compare, "a long, b long"), "a", "b")
    rooted = distinct.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    named = rooted.join(lowest, "root").select("print", "class_id")
    return rows.join(named, "print").select(F.col("_key").alias(key), F.lower(F.hex("print")).alias("fingerprint"), "class_id")
