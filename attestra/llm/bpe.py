"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in blocks of documents; a block keeps its distinct words and, per document, their places.
The words of all blocks are dealt out by their hash, so that each distinct word of the corpus is encoded once, in one
task; its ids go back to its block, become text again there by a join with the table of pieces, and go on to the documents by
place. Only distinct words of a block and places are shuffled, both packed, never texts; no word is hot,
since it occurs once per block.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, restored, small_batches, text_of
from .tokens import KNOWN_WORDS, WHITE_SPACE, encode_words, load_tokenizer

OTHER_SPACE = re.compile("[" + WHITE_SPACE.replace(" ", "").replace("\n", "") + "]")
# Characters of a block of documents at most, unless one document alone has more; bounds the memory of a task.
BLOCK_CHARS = 28_000_000
# Parts that the words are dealt into by their hash.
BUCKETS = 512
# A word takes one space before it; of other white space a run goes up to the place where such a word begins.
WORD = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]")


def split_words(text: str, specials: re.Pattern) -> list[str]:
    """Words whose concatenation is the text; special tokens stand alone."""
    if not specials.search(text):
        return WORD.findall(text)
    return [w for k, part in enumerate(specials.split(text)) for w in ([part] if k % 2 else WORD.findall(part))]


def _special_pattern(path: str) -> re.Pattern:
    names = [t.content for t in load_tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + ")" if names else "(?!)")


def pack_places(places: np.ndarray) -> bytes:
    """Places as compressed planes of bytes: the high ones are nearly constant."""
    return zstandard.compress(places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_places(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_columns(numbers: list[np.ndarray], texts: list[list[bytes]]) -> bytes:
    """Columns of numbers below 2**32 and columns of byte strings, compressed."""
    parts = [np.array([len(n) for n in numbers] + [len(t) for t in texts], dtype="<u4").tobytes()]
    parts += [n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for n in numbers]
    for column in texts:
        parts.append(np.fromiter(map(len, column), dtype="<u4", count=len(column)).view(np.uint8).reshape(-1, 4).T.tobytes())
        parts += column
    return zstandard.compress(b"".join(parts), 3)


def unpack_columns(raw: bytes, numbers: int, texts: int) -> tuple[list[np.ndarray], list[list[bytes]]]:
    raw = zstandard.decompress(raw)
    sizes = np.frombuffer(raw, dtype="<u4", count=numbers + texts).tolist()
    at = 4 * len(sizes)

    def column(n: int) -> np.ndarray:
        nonlocal at
        planes = np.frombuffer(raw, dtype=np.uint8, count=4 * n, offset=at).reshape(4, n)
        at += 4 * n
        return np.ascontiguousarray(planes.T).view("<u4").ravel()

    first = [column(n) for n in sizes[:numbers]]
    second = []
    for n in sizes[numbers:]:
        ends = at + 4 * n + np.cumsum(column(n)).astype(np.int64)
        bounds = [at, *ends.tolist()]
        second.append([raw[a:b] for a, b in zip(bounds, bounds[1:])])
        at = bounds[-1]
    return first, second


class Block:
    """Distinct words of some documents in order of appearance, and the places of each document's words.

    Words behind one space are kept without it in a table of their own, since most texts are words with single
    spaces and line breaks between them and then need no pattern.
    """

    def __init__(self, specials: re.Pattern) -> None:
        next_place = count().__next__
        self.specials, self.chars = specials, 0
        self.plain: dict[str, int] = defaultdict(next_place)
        self.spaced: dict[str, int] = defaultdict(next_place)

    def add(self, text: str) -> np.ndarray:
        self.chars += len(text)
        places: list[int] = []
        if self._regular(text):
            for number, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                if number:
                    places.append(self.plain["\n"])
                places.append(self.plain[first])
                places.extend(map(self.spaced.__getitem__, rest))
        else:
            for word in split_words(text, self.specials):
                places.append(self.spaced[word[1:]] if word[0] == " " and len(word) > 1 and word[1] not in WHITE_SPACE else self.plain[word])
        return np.array(places, dtype=np.uint32)

    def _regular(self, text: str) -> bool:
        """Words with one space or line break between them, no other white space and no special token."""
        return (bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(odd in text for odd in ("  ", " \n", "\n ", "\n\n"))
                and not OTHER_SPACE.search(text) and not self.specials.search(text))

    def words(self) -> Iterator[tuple[str, int]]:
        yield from self.plain.items()
        yield from ((" " + word, place) for word, place in self.spaced.items())

    def buckets(self) -> Iterator[tuple[int, bytes]]:
        """The words and their places by the hash of the word."""
        parts: dict[int, list[tuple[bytes, int]]] = {}
        for word, place in self.words():
            raw = word.encode("utf-8", "surrogatepass")
            parts.setdefault(zlib.crc32(raw) % BUCKETS, []).append((raw, place))
        for bucket, held in parts.items():
            held.sort()
            yield bucket, pack_columns([np.array([p for _, p in held], dtype=np.uint32)], [[w for w, _ in held]])


def _blocks(docs: DataFrame, path: str, words: bool) -> DataFrame:
    """Rows (bucket, block, held) of packed words or rows (block, key, places); both cut the same rows into the same blocks."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        specials = _special_pattern(path)
        number, block = TaskContext.get().partitionId() << 24, Block(specials)

        def table() -> Iterator[pd.DataFrame]:
            if words:
                for bucket, held in block.buckets():
                    yield pd.DataFrame({"bucket": [bucket], "block": [number], "held": [held]})

        for batch in batches:
            rows = []
            for key, text in zip(batch["_key"], batch["_text"]):
                if block.chars and block.chars + len(text) > BLOCK_CHARS:
                    yield from table()
                    number, block = number + 1, Block(specials)
                places = block.add(text)
                if not words:
                    rows.append((number, key, pack_places(places)))
            if rows:
                yield pd.DataFrame(rows, columns=["block", "key", "places"])
        yield from table()

    rows = docs.select("_key", "_text")
    return rows.mapInPandas(cut, "bucket int, block long, held binary" if words else "block long, key string, places binary")


def _size(path: str) -> int:
    return load_tokenizer(path).get_vocab_size(True)


@cache
def _pieces(path: str) -> dict[int, bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    tokenizer = load_tokenizer(path)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    added = {k: t.content for k, t in tokenizer.get_added_tokens_decoder().items()}
    return {k: added[k].encode() if k in added else bytes(map(shown.__getitem__, piece)) for piece, k in tokenizer.get_vocab(True).items()}


def _coded(words: DataFrame, path: str) -> DataFrame:
    """Rows (block, coded): places and ids of the words of a block and bucket."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load_tokenizer(path)
        known: dict[bytes, bytes] = {}
        now = None
        for batch in batches:
            out = []
            for bucket, block, held in zip(batch["bucket"], batch["block"], batch["held"]):
                if bucket != now or len(known) > KNOWN_WORDS:
                    now = bucket
                    known.clear()
                (places,), (found,) = unpack_columns(held, 1, 1)
                new = [w for w in found if w not in known]
                known.update(zip(new, encode_words(tokenizer, [w.decode("utf-8", "surrogatepass") for w in new])))
                ids = list(map(known.__getitem__, found))
                sizes = np.fromiter(map(len, ids), dtype=np.uint32, count=len(ids)) // 4
                out.append((block, pack_columns([places, sizes, np.frombuffer(b"".join(ids), "<u4")], [])))
            yield pd.DataFrame(out, columns=["block", "coded"])

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(encode, "block long, coded binary")


def decode(encoded: DataFrame, keys: list[str], ids: str, path: str) -> DataFrame:
    """The keys, ids and `decoded` bytes of rows that carry an array of ids; keys are unique, rows without an id are left out.

    The table of pieces is sent to all tasks: it has a row per id of the vocabulary.
    """
    table = encoded.sparkSession.createDataFrame(pd.DataFrame([(k, p.hex()) for k, p in _pieces(path).items()], columns=["_id", "_piece"]), "_id int, _piece string")
    each = encoded.select(*keys, F.posexplode(ids).alias("_at", "_id")).join(F.broadcast(table), "_id")
    runs = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_id", "_piece"))).alias("_run"))
    return runs.select(*keys, F.col("_run._id").alias(ids), F.unhex(F.array_join("_run._piece", "")).alias("decoded"))


def encode_and_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Key, n_tokens, ids and decoded text of every row, or the SHA-256 of the last two with `digest`.

    Ids are those of the tokenizer file without added special tokens, truncation or padding; special tokens in a text
    are encoded as such. Null and empty texts have no ids and decode to the empty text. Rows are kept as they are,
    repeated ones and null keys too; other columns are dropped. An empty table gives an empty result. docs is read twice
    and must give the same rows each time, as a table or stored frame does.
    """
    small_batches(docs.sparkSession)
    source = docs.select(carried(key).alias("_key"), text_of(text).alias("_text"))
    coded = _coded(_blocks(source, path, words=True), path)
    outcome = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"

    def assemble(rows: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
        held = [unpack_columns(raw, 3, 0)[0] for raw in dictionary["coded"]]
        size = sum(len(places) for places, _, _ in held)
        ids, decoded, counts = [None] * size, [b""] * size, np.zeros(size, dtype=np.int64)
        piece, number = _pieces(path), list(map(str, range(_size(path))))
        for places, sizes, run in held:
            counts[places] = sizes
            ends, own = np.cumsum(sizes).tolist(), run.tolist()
            begin = 0
            for place, end in zip(places.tolist(), ends):
                part = own[begin:end]
                ids[place] = ",".join(map(number.__getitem__, part)) if digest else part
                decoded[place] = b"".join(map(piece.__getitem__, part))  # the join of ids with pieces, once per word of the block
                begin = end
        out = []
        for name, raw in zip(rows["key"], rows["places"]):
            places = unpack_places(raw)
            run = places.tolist()
            plain = b"".join(map(decoded.__getitem__, run)).decode("utf-8", "replace")
            own = list(map(ids.__getitem__, run))
            if digest:
                own = hashlib.sha256(",".join(own).encode()).hexdigest()
                plain = hashlib.sha256(plain.encode()).hexdigest()
            else:
                own = [k for part in own for k in part]
            out.append((name, int(counts[places].sum()), own, plain))
        return pd.DataFrame(out, columns=["key", "n_tokens", *[c.split()[0] for c in outcome.split(", ")]])

    blocks = _blocks(source, path, words=False)
    schema = f"key string, n_tokens long, {outcome}"
    joined = blocks.groupBy("block").cogroup(coded.groupBy("block")).applyInPandas(assemble, schema)
    return joined.select(restored(docs, key, "key").alias(key), *joined.columns[1:])
