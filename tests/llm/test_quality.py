"""Trees: held-out accuracy, flattened traversal against a walk node by node, odd rows and degenerate labels."""

import zlib

import numpy as np
import pandas as pd
from helpers import empty_documents, odd_documents

from attestra.llm import quality
from attestra.llm.queries import QUERIES


def test_held_out_accuracy(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op8_quality"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    kept = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([r["score"] for r in kept if labels[r["doc_id"]] == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.98


def test_traversal():
    random = np.random.default_rng(1)
    x = random.normal(size=(500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = quality.fit(x, y, trees=30)
    score = forest.score(x)
    for k in range(0, 500, 25):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if x[k, forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert abs(score[k] - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((score > 0.5) == y).mean() > 0.97


def test_statistics():
    table = quality.table_of(pd.Series(["", " \n", "\x01 \x02", "a", "Word, word!! word", "漢字 漢字", "x " * 100_000]))
    assert table.shape == (7, len(quality.STATISTICS)) and np.isfinite(table).all() and not table[:2].any()


def test_degenerate_labels(spark):
    df, rows = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None), (4, 1), (4, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        forest = quality.train(df, known)
        out = quality.scored(df, forest)
        assert out.columns == [*df.columns, "score"]
        assert len({round(r["score"], 9) for r in out.collect()}) == 1
    mixed = spark.createDataFrame([(k, k % 2) for k in range(1, 11)], "doc_id long, quality int")
    forest = quality.train(df, mixed)
    assert quality.scored(df, forest).count() == len(rows)
    assert quality.scored(empty_documents(spark), quality.train(empty_documents(spark), mixed)).collect() == []
