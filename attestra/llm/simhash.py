"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are grouped into tiles of equal population counts of their four 16-bit words. Two fingerprints that
differ in at most r bits have counts whose absolute differences sum to at most r, so tile pairs beyond that are
skipped without losing a link; the others are compared whole with numpy exclusive-or and bit counts. Where a link
stands for an overlap of shingles, only fingerprints of texts that have one of their smallest shingle hashes in common
are compared, which no such overlap is without; the pairs found are candidates, and exact overlaps decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, tabled, text_of
from .components import components
from .spans import bitmap, marked

WORD_BITS = 16
WORDS = 64 // WORD_BITS
TILE_ROWS = 4096
# Cells of one exclusive-or matrix, which bounds the memory of a comparison to a few MB.
MATRIX_CELLS = 1 << 20
# Shingle hashes of a block of candidates that are compared exactly, and what a row counts beside its hashes.
BLOCK_BYTES = 4 << 20
ROW_BYTES = 1024
# Fingerprints of one shingle hash that are compared pair by pair, many hashes at once; more are compared as a tile.
FEW_ROWS = 64


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another 64 bits of every hash; turn 0 leaves it as it is."""
    if turn == 0:
        return hashes
    x = hashes + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _shingles(text: str, words: int, seed: int = 42) -> np.ndarray:
    """A hash of every shingle, repeats included; of the whole sequence where it has fewer words, none without any word."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        shingles = [b" ".join(found)] if found else []
    else:
        shingles = map(b" ".join, zip(*[found[k:] for k in range(words)]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles], dtype="<u8")


def _bits(hashes: np.ndarray, parts: int) -> list[int]:
    """`parts` times 64 bits, each set if it is set in over half of the hashes; 0 without any hash."""
    counts = np.zeros((parts, 64), dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        for turn in range(parts):
            raw = _mixed(hashes[at:at + 4096], turn).view(np.uint8).reshape(-1, 8)
            counts[turn] += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().tolist()


def codes(text: str, words: int = 3, parts: int = 1, seed: int = 42) -> list[int]:
    """`parts` times 64 bits, each set if it is set in over half of the shingle hashes; 0 without any word."""
    return _bits(_shingles(text, words, seed), parts)


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, parts: int = 1) -> DataFrame:
    """The rows with `codes`, signed longs from the whole text, and `fp`, one long that names them, in place of the text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(codes(t, words, parts), dtype=np.uint64).view(np.int64) for t in texts])

    named = F.get("codes", F.lit(0)) if parts == 1 else F.xxhash64("codes")
    return docs.withColumn("codes", of(text_of(text))).withColumn("fp", named).drop(text)


def _leading(hashes: np.ndarray, least: float) -> np.ndarray:
    """The smallest of the ascending hashes of a set, so many that every set that overlaps with it by `least` or more has one of them among its own.

    Such a set holds at least `least` of the hashes, so the smallest common one has no more hashes before it than the others are.
    """
    return hashes[:len(hashes) - math.ceil(least * len(hashes) * (1 - 1e-12)) + 1]


def _sketches(words: int, parts: int, least: float):
    """A column function from a text to (codes, fp, n, leading): bits over its distinct shingles, a hash of their set, their number and its leading hashes."""

    @F.pandas_udf("codes array<long>, fp long, n long, leading array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(_shingles(t, words)) for t in texts]
        return pd.DataFrame({
            "codes": [np.array(_bits(s, parts), dtype=np.uint64).view(np.int64) for s in sets],
            "fp": np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], dtype=np.uint64).view(np.int64),
            "n": np.array([len(s) for s in sets], dtype=np.int64),
            "leading": [_leading(s, least).view(np.int64) for s in sets]})

    return of


def _shingle_sets(words: int):
    """A column function from a text to the sorted distinct hashes of its shingles, eight bytes each."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_shingles(t, words)).tobytes() for t in texts], dtype=object)

    return of


def _part(value: Column, k: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(value, k * WORD_BITS).bitwiseAND(F.lit((1 << WORD_BITS) - 1)))


def _offsets(radius: int, words: int) -> list[int]:
    """Packed differences of `words` counts within the radius, one of each opposite pair."""
    steps = range(-radius, radius + 1)
    near = [o for o in product(steps, repeat=words) if sum(map(abs, o)) <= radius and o >= (0,) * words]
    return [sum(x << (8 * k) for k, x in enumerate(reversed(o))) for o in near]


def _matches(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs within the radius.

    Of several words, one has to lie within its share of the radius; only such pairs are summed up.
    """
    words = left.shape[1]
    near = np.zeros((len(left), len(right)), dtype=bool)
    for k in range(words):
        near |= np.bitwise_count(left[:, k][:, None] ^ right[:, k][None, :]) <= radius // words
    i, j = np.nonzero(near)
    if words > 1:
        within = np.bitwise_count(left[i] ^ right[j]).sum(axis=1, dtype=np.int64) <= radius
        i, j = i[within], j[within]
    return i, j


def _joined(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A star per connected group of the two tiles: no more edges than fingerprints, the same components.

    The first column names a fingerprint, the others are its words.
    """
    nodes = np.concatenate([left[:, 0], right[:, 0]])
    left, right = left[:, 1:], right[:, 1:]
    label = np.arange(len(nodes))  # a root between blocks, so joined roots take all their nodes along
    if same:
        label[len(left):] = label[:len(left)]
    rows = max(1, MATRIX_CELLS // len(right))
    met = np.zeros(len(nodes), dtype=bool)
    for at in range(0, len(left), rows):
        i, j = _matches(left[at:at + rows], right, radius)
        i, j = i + at, j + len(left)
        met[i] = met[j] = True
        while True:
            one, other = label[i], label[j]
            apart = one != other
            if not apart.any():
                break
            i, j, one, other = i[apart], j[apart], one[apart], other[apart]
            np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
            while not np.array_equal(label, below := label[label]):
                label = below
    keep = met & (label != np.arange(len(nodes)))
    a, b = nodes[label[keep]], nodes[keep]
    return a[a != b], b[a != b]


def links(distinct: DataFrame, radius: int = 3, tile_rows: int = TILE_ROWS, parts: int = 1) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links within the radius.

    Columns of the input: fp and codes. Fingerprints of one long are tiled by the counts of its four words, longer ones
    by their whole count, so signatures number at most 17 to the fourth and their counts are sent to all tasks.
    """
    small_batches(distinct.sparkSession)
    if parts == 1:
        counts = sum((_part(F.get("codes", F.lit(0)), k) * (1 << (8 * k)) for k in range(WORDS)), F.lit(0)).cast("bigint")
        steps = _offsets(radius, WORDS)
    else:
        counts = F.aggregate("codes", F.lit(0).cast("bigint"), lambda total, code: total + F.bit_count(code))
        steps = _offsets(radius, 1)
    signed = distinct.select("fp", "codes", counts.alias("sig"))
    sizes = signed.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("n"))
    tiles = (signed.join(F.broadcast(sizes), "sig").groupBy("sig", F.pmod(F.xxhash64("fp"), "n").alias("tile"))
             .agg(F.flatten(F.collect_list(F.concat(F.array("fp"), "codes"))).alias("fps")))
    tiles = stored(tiles)
    offsets = F.array(*[F.lit(o).cast("bigint") for o in steps])
    near = tiles.select("sig", "tile", F.explode(F.transform(offsets, lambda o: F.col("sig") + o)).alias("other"))
    there = tiles.groupBy("sig").agg(F.count(F.lit(1)).alias("_n")).select(F.col("sig").alias("other"))
    wanted = near.join(F.broadcast(there), "other", "left_semi").groupBy("sig").agg(F.collect_set("other").alias("others"))
    left = (tiles.join(F.broadcast(wanted), "sig")
            .select(F.col("sig").alias("l_sig"), F.col("tile").alias("l_tile"), F.col("fps").alias("l"), F.explode("others").alias("sig")))
    pairs = (left.join(tiles.withColumnRenamed("fps", "r"), "sig")
             .where("l_sig <> sig or l_tile <= tile")
             .select("l", "r", F.expr("l_sig = sig and l_tile = tile").alias("same")))

    return pairs.mapInPandas(_compared(radius, parts), "a long, b long")


def _table(fps: np.ndarray, parts: int) -> np.ndarray:
    """A row per fingerprint: its name and its words."""
    return np.asarray(fps, dtype=np.int64).view(np.uint64).reshape(-1, 1 + parts)


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a = np.concatenate([f[0] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64)
    b = np.concatenate([f[1] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64)
    return pd.DataFrame({"a": a, "b": b})


def _compared(radius: int, parts: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Edges of tile pairs: columns l, r and whether they are the same tile."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _edges([_joined(_table(l, parts), _table(r, parts), radius, same) for l, r, same in zip(batch["l"], batch["r"], batch["same"])])

    return compare


def _within(tiles: list[np.ndarray], radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges within each of many tiles; small ones are compared together, pair by pair."""
    small = [t for t in tiles if len(t) <= FEW_ROWS]
    found = [_joined(t, t, radius, True) for t in tiles if len(t) > FEW_ROWS]
    if small:
        rows, sizes = np.concatenate(small), np.array([len(t) for t in small])
        end = np.repeat(np.cumsum(sizes), sizes)
        later = end - np.arange(len(rows)) - 1
        i = np.repeat(np.arange(len(rows)), later)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        near = np.bitwise_count(rows[i, 1:] ^ rows[j, 1:]).sum(axis=1, dtype=np.int64) <= radius
        pair = np.unique(np.sort(np.stack([rows[i[near], 0], rows[j[near], 0]], axis=1), axis=1), axis=0)
        found.append((pair[:, 0], pair[:, 1]))
    return found


def shared_links(distinct: DataFrame, radius: int, least: float, tile_rows: int = TILE_ROWS, parts: int = 1) -> DataFrame:
    """Edges (a, b) within the radius whose components hold every pair within it whose sets overlap by `least` or more.

    Columns of the input: fp, codes, n and leading. Only fingerprints that have a leading hash in common are compared. A hash of
    more than `tile_rows` of them is compared in tiles of like set sizes, since sizes of such an overlap are within `least`, too.
    """
    small_batches(distinct.sparkSession)
    often = tabled(distinct.select(F.explode("leading").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    repeats = bitmap(often, "h")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("leading")
            h, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
            keep = pa.array(np.flatnonzero(marked(repeats, h.to_numpy(zero_copy_only=False))))
            row = row.take(keep)
            yield pa.RecordBatch.from_arrays([h.take(keep), *[batch.column(c).take(row) for c in ("fp", "n", "codes")]], ["h", "fp", "n", "codes"])

    met = distinct.select("fp", "n", "codes", "leading").mapInArrow(emit, "h long, fp long, n long, codes array<long>")
    crowded = F.broadcast(often.where(F.col("rows") > tile_rows).select("h"))
    rows = F.flatten(F.collect_list(F.concat(F.array("fp"), "codes")))
    few = met.join(crowded, "h", "left_anti").groupBy("h").agg(rows.alias("fps"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("fps")

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _edges(_within([_table(fps, parts) for fps in batch["fps"]], radius))

    like = F.floor(F.log("n") / (math.log(1 / least) * (1 + 1e-9)))
    many = met.join(crowded, "h").withColumn("size", like)
    counts = many.groupBy("h", "size").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("tiles"))
    tiles = tabled(many.join(counts, ["h", "size"]).groupBy("h", "size", F.pmod(F.xxhash64("fp"), "tiles").alias("tile")).agg(rows.alias("l")))
    right = tiles.withColumnsRenamed({"tile": "r_tile", "l": "r"})
    left = tiles.select("h", "tile", "l", F.col("size").alias("l_size"), F.explode(F.array("size", F.col("size") + 1)).alias("size"))
    pairs = (left.join(right, ["h", "size"]).where("l_size <> size or tile <= r_tile")
             .select("l", "r", F.expr("l_size = size and tile = r_tile").alias("same")))
    return few.mapInPandas(within, "a long, b long").unionByName(pairs.mapInPandas(_compared(radius, parts), "a long, b long"))


def _overlapping(left: list, right: list | None, radius: int, least: float) -> list[tuple[int, int]]:
    """Edges whose components are those of all pairs of left and right (None: pairs within left) with codes within the
    radius and shingle sets that overlap by `least` or more.

    Rows are (name, codes, sorted shingle hashes). A pair that is joined already is not looked at again, so a dense
    group costs about one comparison a row.
    """
    rows = left + (right or [])
    sets = [np.frombuffer(r["shingles"], dtype="<u8") for r in rows]
    sizes = np.array([len(s) for s in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    bits = np.array([r["codes"] for r in rows], dtype=np.int64).view(np.uint64)
    marked = np.zeros(1 + max((int(i.max()) for i in ids if len(i)), default=0), dtype=bool)
    label = np.arange(len(rows))
    edges = []
    for i in range(len(left)):
        j = np.arange(i + 1 if right is None else len(left), len(rows))
        j = j[(label[j] != label[i]) & (np.minimum(sizes[j], sizes[i]) / np.maximum(np.maximum(sizes[j], sizes[i]), 1) >= least)]
        j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) <= radius]
        marked[ids[i]] = True
        width = 8
        while len(j):
            some, j = j[:width], j[width:]
            common = np.array([np.count_nonzero(marked[ids[k]]) for k in some])
            for k in some[common / (sizes[i] + sizes[some] - common) >= least]:
                if label[k] != label[i]:
                    edges.append((rows[i]["fp"], rows[k]["fp"]))
                    label[label == label[k]] = label[i]
            j = j[label[j] != label[i]]
            width *= 2
        marked[ids[i]] = False
    return edges


def verified_links(texts: DataFrame, radius: int, words: int, least: float) -> DataFrame:
    """Edges (a, b) within groups of candidates whose components are those of all exact links.

    Columns of the input: root (the group), block (of a group, from 0), blocks (their number), fp, codes and _text. A block
    is compared with itself and with every later block of its group, so no task holds more than two blocks.
    """
    sets = texts.withColumn("shingles", _shingle_sets(words)("_text"))
    blocks = tabled(sets.groupBy("root", "block", "blocks").agg(F.collect_list(F.struct("fp", "codes", "shingles")).alias("l")))
    later = blocks.where("block > 0").select("root", F.col("block").alias("other"), F.col("l").alias("r"))
    across = (blocks.where("block < blocks - 1").select("root", "l", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("other"))
              .join(later, ["root", "other"]).select("l", "r"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rights = batch["r"] if "r" in batch else [None] * len(batch)
            found = [e for l, r in zip(batch["l"], rights) for e in _overlapping(list(l), None if r is None else list(r), radius, least)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return blocks.select("l").mapInPandas(compare, "a long, b long").unionByName(across.mapInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, words: int = 3,
                    tile_rows: int = TILE_ROWS) -> DataFrame:
    """Columns key, fingerprint (16 hex digits) and component_id, the smallest key reachable over links.

    A link joins fingerprints that differ in at most `radius` bits. Null texts count as empty; texts without words
    have fingerprint zero and link like others; repeated rows stay; a null key never names a component unless all
    keys of it are null. Further columns are dropped, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = stored(fingerprints(rows, "_text", words))
    distinct = stored(rows.groupBy("fp").agg(F.min("codes").alias("codes"), F.min("_key").alias("_key")))
    labels = components(links(distinct, radius, tile_rows), "a", "b").withColumnRenamed("node", "fp")
    rooted = distinct.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("_key").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return (rows.join(named, "fp")
            .select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, radius: int = 72, words: int = 5,
                    parts: int = 4, tile_rows: int = TILE_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One whole row of docs per component: that of the smallest key, of several such rows that of the smallest text hash.

    A link joins texts whose sets of lower-cased five-word shingles overlap by `least` or more, counted exactly; the
    fingerprints, 256 bits over distinct shingles, only search candidates. At an overlap of 0.8 they differ in 39 bits on
    average and, for texts of four shingles, the widest, in 48 with a deviation of 6; unrelated ones in 128 with 8.

    Texts without words form one component. Null keys come last. All columns are kept, whatever their names; of rows
    equal in key and text one is kept. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("_key"), F.xxhash64(text_of(text)).alias("_row"))
    rows = keyed.select("_key", "_row", _sketches(words, parts, least)(text_of(f"row.{text}")).alias("s")).select("_key", "_row", "s.*")
    distinct = tabled(rows.groupBy("fp").agg(F.min("codes").alias("codes"), F.min("n").alias("n"), F.min("leading").alias("leading"),
                                             F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_row")).alias("best")))
    maybe = components(shared_links(distinct, radius, least, tile_rows, parts), "a", "b").withColumnRenamed("node", "fp")
    groups = stored(distinct.join(maybe, "fp").select("root", "fp", "codes", "n", "best"))
    weight = F.sum(8 * F.col("n") + ROW_BYTES)
    large = groups.groupBy("root").agg(F.ceil(weight / block_bytes).cast("int").alias("blocks")).where("blocks > 1")
    placed = (groups.join(large, "root", "left").fillna(1, ["blocks"])
              .select("root", "fp", "codes", "blocks", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block"),
                      F.col("best._key").alias("of_key"), F.col("best._row").alias("of_row")))
    first = keyed["_key"].eqNullSafe(placed["of_key"]) & (keyed["_row"] == placed["of_row"])
    texts = keyed.select("_key", "_row", text_of(f"row.{text}").alias("_text")).join(placed, first).dropDuplicates(["fp"])
    labels = components(verified_links(texts, radius, words, least), "a", "b").withColumnRenamed("node", "fp")
    rooted = distinct.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = rooted.groupBy("root").agg(F.min("best").alias("of")).select("of._key", "of._row")
    same = keyed["_key"].eqNullSafe(chosen["_key"]) & (keyed["_row"] == chosen["_row"])
    return keyed.join(chosen, same, "left_semi").dropDuplicates(["_key", "_row"]).select("row.*")
