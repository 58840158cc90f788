"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Arrow batches. The trees are fitted with numpy on a bounded sample of
labelled rows, flattened into arrays of nodes, and traversed for all documents of a batch and all trees at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

# Labelled rows that the trees are fitted on at most: those of the smallest hash of their key.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
STATISTICS = ("log_bytes", "log_words", "word_bytes", "word_spread", "longest_word", "upper", "digits", "marks", "stops", "shouts", "signs",
              "bars", "blanks", "lines", "beyond_ascii", "entropy", "distinct_words", "top_word", "same_next", "distinct_lines",
              "stopped_words", "signed_words", "capital_words")

# The bytes that part words.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def statistics(text: str) -> list[float]:
    """The document statistics of one text, in the order of STATISTICS; all zero without any word."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(b" " + raw + b" ", dtype=np.uint8)
    counts = np.bincount(codes[1:-1], minlength=256)
    share = counts / len(raw)
    blank = BLANK[codes]
    begin, end = np.flatnonzero(blank[:-1] > blank[1:]) + 1, np.flatnonzero(blank[:-1] < blank[1:])
    sizes = end - begin + 1
    first, last = (np.bincount(codes[at], minlength=128) / len(sizes) for at in (begin, end))
    seen = Counter(words)
    lines = raw.split(b"\n")
    some = share[counts > 0]
    marks = share[33:48].sum() + share[58:65].sum() + share[91:97].sum() + share[123:127].sum()
    signs = [35, 36, 37, 38, 42]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sizes.mean(), sizes.std(), np.log1p(sizes.max()), share[65:91].sum(), share[48:58].sum(),
        marks, share[46], share[33], share[signs].sum(), share[124], share[32], share[10], share[128:].sum(), -(some * np.log2(some)).sum(),
        len(seen) / len(words), max(seen.values()) / len(words), sum(map(bytes.__eq__, words, words[1:])) / len(words),
        len(set(lines)) / len(lines), last[[33, 44, 46, 58, 59, 63]].sum(), last[signs].sum(), first[65:91].sum()]


def table_of(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))


@dataclass(frozen=True)
class Forest:
    """Flattened trees: node arrays over all trees; a leaf points to itself."""
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0,
        min_weight: float = 2.0) -> Forest:
    """Boosted trees for the logistic loss. Without rows of both labels the score is constant: their share, or a half."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    empty = np.zeros(0, dtype=np.int64)
    if len(np.unique(y)) < 2:
        return Forest(empty, empty, np.zeros(0), empty, empty, np.zeros(0), base, 0)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(g: float, h: float) -> int:
        feature.append(0), threshold.append(np.inf), value.append(-rate * g / (h + ridge))
        left.append(len(left)), right.append(len(right))
        return len(left) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        if level < depth and len(rows) > 1:
            for f in range(x.shape[1]):
                hist_g = np.cumsum(np.bincount(binned[rows, f], g[rows], bins))
                hist_h = np.cumsum(np.bincount(binned[rows, f], h[rows], bins))
                rest_g, rest_h = total_g - hist_g, total_h - hist_h
                gain = hist_g ** 2 / (hist_h + ridge) + rest_g ** 2 / (rest_h + ridge) - total_g ** 2 / (total_h + ridge)
                gain[(hist_h < min_weight) | (rest_h < min_weight)] = 0
                k = int(np.argmax(gain[:len(cuts[f])])) if len(cuts[f]) else 0
                if len(cuts[f]) and gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] < 0:
            return leaf(total_g, total_h)
        _, f, k = best
        node = leaf(total_g, total_h)
        goes_left = binned[rows, f] <= k
        a, b = grow(rows[goes_left], g, h, level + 1), grow(rows[~goes_left], g, h, level + 1)
        feature[node], threshold[node], left[node], right[node] = f, cuts[f][k], a, b
        return node

    everything = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(everything, p - y, np.maximum(p * (1 - p), 1e-6), 0))
        tree = Forest(np.array(roots[-1:]), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), 0.0, depth)
        at = np.full(len(y), roots[-1])
        for _ in range(depth):
            at = np.where(x[everything, tree.feature[at]] <= tree.threshold[at], tree.left[at], tree.right[at])
        margin += tree.value[at]
    return Forest(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), base, depth)


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows that the classifier never learns from; a null key counts as held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "utf-8")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          train_rows: int = TRAIN_ROWS) -> Forest:
    """Fit on at most `train_rows` labelled rows outside the held-out fold, taken by the hash of their key.

    Null labels and keys are left out; of several labels of one key the smallest counts.
    """
    small_batches(docs.sparkSession)
    known = (labels.where(F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("_key"))
             .agg(F.min(F.col(label).cast("int")).alias("_label")))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(train_rows)
    rows = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text")).join(F.broadcast(chosen), "_key")
    rows = rows.groupBy("_key", "_label").agg(F.min("_text").alias("_text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["_key"], "y": batch["_label"], "x": list(table_of(batch["_text"]))})

    sample = rows.mapInPandas(measure, f"k {docs.schema[key].dataType.simpleString()}, y int, x array<double>").toPandas()
    sample = sample.sort_values("k", kind="stable")
    x = np.array(list(sample["x"]), dtype=np.float64).reshape(-1, len(STATISTICS))
    return fit(x, sample["y"].to_numpy(dtype=np.float64))


def scored(docs: DataFrame, forest: Forest, text: str = "text", name: str = "score") -> DataFrame:
    """The rows and their score; null texts count as empty. An input column of that name is replaced."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        parts = [forest.score(table_of(texts.iloc[at:at + 256])) for at in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, of(text_of(text)))
