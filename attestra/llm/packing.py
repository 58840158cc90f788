"""Packing into sequences: vector bin packing with a dot-product heuristic.

A sequence is limited in tokens, segments and loss-bearing tokens at once. From a bounded pool of waiting pieces the
one whose demands have the largest dot product with what the open sequence has left is placed, until none fits; where
pieces may be cut, a last one is cut to fill the sequence. Every partition packs its own rows in one pass: no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, restored, small_batches, text_of
from .tokens import word_encoder

# Pieces that wait to be placed at most.
POOL = 512


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""
    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048


# A document has at least its end id, so tokens are used up before these segments.
DOCUMENT_LIMITS = Limits(segments=2048)


class Packer:
    """Places (name, start, length, loss) pieces, with `cut` also parts of pieces that bear loss throughout; `place` and `finish` return (name, start, length, sequence, offset)."""

    def __init__(self, limits: Limits, cut: bool, first: int, pool: int = POOL) -> None:
        self.limits, self.cut, self.next, self.pool = limits, cut, first, pool
        self.names: list = []
        self.pieces = np.zeros((0, 3), dtype=np.int64)  # start, length, loss
        self.waiting: list[tuple] = []

    def add(self, name, start: int, length: int, loss: int) -> None:
        self.waiting.append((name, start, length, loss))

    def place(self, until: int | None = None) -> list[tuple]:
        """Fill sequences until at most `until` pieces wait or, unless that is 0, the waiting ones reach no limit."""
        until = self.pool if until is None else until
        out: list[tuple] = []
        if len(self.names) + len(self.waiting) <= until:
            return out
        self.names += [w[0] for w in self.waiting]
        self.pieces = np.concatenate([self.pieces, np.array([w[1:] for w in self.waiting], dtype=np.int64).reshape(-1, 3)])
        self.waiting = []
        limits = self.limits
        while len(self.names) > until:
            _, tokens, loss = self.pieces.sum(axis=0)
            if until and tokens < limits.tokens and len(self.names) < limits.segments and loss < limits.loss_tokens:
                break
            out += self._sequence()
        return out

    def finish(self) -> list[tuple]:
        return self.place(0)

    def _sequence(self) -> list[tuple]:
        most = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], dtype=np.int64)
        demand = np.stack([self.pieces[:, 1], np.ones(len(self.pieces), np.int64), self.pieces[:, 2]], axis=1)
        weight = demand / most
        left, placed, chosen = most.copy(), np.zeros(len(demand), dtype=bool), []
        while left[0] > 0 and left[1] > (1 if self.cut else 0):
            score = np.where(placed | (demand > left).any(axis=1), -1.0, weight @ (left / most))
            best = int(np.argmax(score))
            if score[best] < 0:
                break
            placed[best] = True
            chosen.append((best, int(self.pieces[best, 1])))
            left -= demand[best]
        if self.cut and left.min() > 0 and not placed.all():
            best = int(np.argmax(np.where(placed, -1, demand[:, 0])))
            size = int(min(left[0], left[2], demand[best, 0]))
            chosen.append((best, size))
            placed[best] = size == demand[best, 0]
        out, offset, sequence = [], 0, self.next
        self.next += 1
        for k, size in chosen:
            out.append((self.names[k], int(self.pieces[k, 0]), size, sequence, offset))
            offset += size
        k, size = chosen[-1]
        if not placed[k]:
            self.pieces[k] += (size, -size, -size)
        self.pieces = self.pieces[~placed]
        self.names = [n for n, gone in zip(self.names, placed) if not gone]
        return out


def _first_sequence() -> int:
    return TaskContext.get().partitionId() << 32


def pack_examples(examples: DataFrame, key: str, tokens: str, loss_tokens: str, limits: Limits = Limits()) -> DataFrame:
    """Whole examples in sequences: key, tokens, loss_tokens, sequence_id and offset of every row; other columns are dropped.

    Null counts are zero. An example beyond a limit by itself gets no sequence (nulls); an example of no tokens takes
    a segment. Repeated rows are separate examples. An empty table gives an empty result.
    """
    rows = examples.select(carried(key).alias("_key"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(n) for c, n in ((tokens, "_tokens"), (loss_tokens, "_loss"))])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(limits, cut=False, first=_first_sequence())
        frame = lambda out: pd.DataFrame([(n[0], n[1], n[2], q, o) for n, _, _, q, o in out], columns=list("ktlso")).astype({"s": "Int64", "o": "Int64"})
        for batch in batches:
            over = []
            for name in zip(batch["_key"], batch["_tokens"], batch["_loss"]):
                if name[1] > limits.tokens or name[2] > limits.loss_tokens or limits.segments < 1:
                    over.append((name, 0, 0, None, None))
                else:
                    packer.add(name, 0, name[1], name[2])
            yield frame(over + packer.place())
        yield frame(packer.finish())

    out = rows.mapInPandas(pack, "k string, t long, l long, s long, o long")
    return out.select(restored(examples, key, "k").alias(key), F.col("t").alias(tokens), F.col("l").alias(loss_tokens), F.col("s").alias("sequence_id"), F.col("o").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, limits: Limits = DOCUMENT_LIMITS) -> DataFrame:
    """All tokens of all documents in sequences, documents cut where that fills a sequence; every token bears loss.

    One row per piece: key, start, length, ids_crc32, doc_tokens (with the end id), sequence_id, offset. Null and
    empty texts have the end id alone. Repeated rows and keys are separate documents. Other columns are dropped,
    whatever their names. An empty table gives an empty result. Only the last sequence of a partition can be short, unless `limits` has fewer segments than tokens.
    """
    small_batches(docs.sparkSession)
    size = min(limits.tokens, limits.loss_tokens)
    limits = Limits(size, limits.segments, size)
    end = np.array([end_id], dtype="<u4").tobytes()
    rows = docs.select(carried(key).alias("_key"), text_of(text).alias("_text"))
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, packer = word_encoder(tokenizer), Packer(limits, cut=True, first=_first_sequence())

        def pieces(out: list[tuple]) -> pd.DataFrame:
            # the name of a waiting piece: key, its ids, the place of its first id in the document, tokens of the document
            return pd.DataFrame([(n[0], s, c, zlib.crc32(n[1][4 * (s - n[2]):4 * (s - n[2] + c)]), n[3], q, o) for n, s, c, q, o in out], columns=names)

        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at:at + 64]
                out = []
                for name, raw in zip(part["_key"], encoder.encode(part["_text"].tolist())):
                    raw += end
                    n = len(raw) // 4
                    whole = n - n % size
                    for start in range(0, whole, size):
                        out.append(((name, raw, 0, n), start, size, packer.next, 0))
                        packer.next += 1
                    if whole < n:
                        packer.add((name, raw[4 * whole:], whole, n), whole, n - whole, n - whole)
                yield pieces(out + packer.place())
        yield pieces(packer.finish())

    schema = "key string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInPandas(pack, schema).select(restored(docs, key, "key").alias(key), *names[1:])
