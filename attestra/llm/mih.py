"""Nearest neighbours by cosine through multi-index hashing.

Vectors become binary codes by learned rotations (iterative quantisation, fitted on a bounded sample). Codes are split into
substrings and each substring is indexed. If two codes differ in at most r bits, some substring of the k differs in at most
r / k bits, so probing those buckets retrieves every code within the radius; the retrieved vectors are then ranked
by their cosine in double precision. The radius is learned on the sample from the distances of true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Vectors that rotations and radius are learned from at most: those of the smallest hash of their key.
SAMPLE_ROWS = 4096
ROTATIONS = 2
SUBSTRING_BITS = 16
# Vectors of one indexed block and queries of one block, which bound the memory of a task.
BLOCK_ROWS = 4096
QUERY_ROWS = 512
NEIGHBOUR_SHARE = 0.98


@dataclass(frozen=True)
class Coder:
    """Rotations (dims x bits) and the search radius in bits."""
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Substrings of the codes, one column each."""
        bits = (unit - self.mean) @ self.turn > 0
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % SUBSTRING_BITS)))
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def learn(sample: np.ndarray, k: int, rotations: int = ROTATIONS, rounds: int = 30, seed: int = 7) -> Coder:
    """Rotations by alternating between signs and the best orthogonal map to them; the radius covers most true neighbours."""
    unit = units(sample)
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    random = np.random.default_rng(seed)
    turns = []
    for _ in range(rotations):
        turn, _ = np.linalg.qr(random.normal(size=(axes.shape[0], axes.shape[0])))
        projected = centred @ axes.T
        for _ in range(rounds):
            u, _, v = np.linalg.svd(projected.T @ np.where(projected @ turn > 0, 1.0, -1.0))
            turn = u @ v
        turns.append(axes.T @ turn)
    coder = Coder(mean, np.concatenate(turns, axis=1), 0)
    codes = coder.codes(unit)
    asked = np.arange(0, len(unit), max(1, len(unit) // 256))
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-near, axis=1)[:, :min(k, len(unit) - 1)]
    apart = np.bitwise_count(codes[asked][:, None, :] ^ codes[best]).sum(axis=2)
    radius = int(np.quantile(apart, NEIGHBOUR_SHARE)) if apart.size else codes.shape[1] * SUBSTRING_BITS
    return Coder(mean, coder.turn, radius)


class Index:
    """The codes of a block, each substring indexed by its value: bucket values, and the bucket of every row."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.buckets = [np.unique(column, return_inverse=True) for column in codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of every code within the radius: those in probed buckets, checked on the whole code."""
        share, rest = divmod(radius, len(self.buckets))
        found = np.zeros(len(self.codes), dtype=bool)
        for k, (values, bucket) in enumerate(self.buckets):
            # of all substrings, the first rest + 1 have to be probed up to share bits, the others up to one less
            found |= (np.bitwise_count(values ^ code[k]) <= (share if k <= rest else share - 1))[bucket]
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64) <= radius]


def _sound(vector: Column) -> Column:
    """Whether a vector can be compared: not null, no null or non-finite component, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False)) & F.exists(vector, lambda x: x != 0)


def search(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """Columns query_id, rank, vec_id and score: the k nearest rows found for each query, ties to the smaller key.

    queries are rows of the table (same columns); a row is never its query's own neighbour, repeated keys included. Vectors that
    are null, zero or hold null or non-finite components, rows with a null key and vectors of another length than most of the
    sample take no part; of repeated query keys the smallest vector counts, repeated rows are candidates each. A query with fewer than k codes within the radius is ranked over all rows of a block. Other
    columns are dropped. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    pick = lambda df: df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("key").isNotNull() & _sound(F.col("v")))
    base, asked = pick(rows), pick(queries).groupBy("key").agg(F.min("v").alias("v"))
    sample = base.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).toPandas()["v"]
    kind = rows.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {kind}, score double"
    if sample.empty:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    dims = int(sample.map(len).mode().iloc[0])
    coder = learn(np.array([v for v in sample if len(v) == dims], dtype=np.float64), k)
    base, asked = base.where(F.size("v") == dims), asked.where(F.size("v") == dims)
    counts = asked.count(), base.count()
    ask_blocks, row_blocks = max(1, -(-counts[0] // QUERY_ROWS)), max(1, -(-counts[1] // BLOCK_ROWS))
    # every block of queries meets every block of rows: the query set is stated, the rows are copied once per query block
    left = asked.withColumn("q", F.pmod(F.xxhash64("key", F.lit("q")), F.lit(ask_blocks))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    right = base.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(row_blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ask_blocks - 1).cast("bigint"))))

    def nearest(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        block = block.sort_values("key", kind="stable")
        keys, vectors = block["key"].to_numpy(), np.array(list(block["v"]), dtype=np.float64)
        asks, wanted = queries["key"].to_numpy(), np.array(list(queries["v"]), dtype=np.float64)
        norms = np.linalg.norm(vectors, axis=1)
        index, codes = Index(coder.codes(vectors / norms[:, None])), coder.codes(units(wanted))
        out = []
        for ask, code, vector in zip(asks, codes, wanted):
            at = index.within(code, coder.radius)
            at = at[keys[at] != ask]
            if len(at) < k:
                at = np.flatnonzero(keys != ask)
            score = (vectors[at] * vector).sum(axis=1) / (norms[at] * np.linalg.norm(vector))
            if len(at) > k:
                near = np.flatnonzero(score >= np.partition(score, -k)[-k])
                at, score = at[near], score[near]
            best = np.lexsort((keys[at], -score))[:k]
            out.append(pd.DataFrame({"query_id": ask, "vec_id": keys[at[best]], "score": score[best]}))
        return pd.concat(out)

    found = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInPandas(nearest, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
