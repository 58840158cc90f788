"""Shards: near-equal bytes, gapless slots, groups kept where they are not heavy."""

import zlib
from collections import Counter, defaultdict

import pytest
from helpers import empty_documents, odd_documents, prose
from pyspark.sql import functions as F

from attestra.llm import sharding
from attestra.llm.common import range_index
from attestra.llm.queries import QUERIES


def check(rows, texts):
    slots, sizes = defaultdict(list), Counter()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_query(spark, small):
    texts = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    sizes = check(QUERIES["op1_sharding"](spark, small).collect(), texts)
    assert max(abs(s - sum(sizes.values()) / 8) for s in sizes.values()) <= max(len(t.encode()) for _, t in texts)


def test_hot_group(spark):
    texts = [(k, prose(k, 3)) for k in range(1500)] + [(5000 + k, "the same text in a third of all rows " * 5) for k in range(900)] + [(9000, prose(9, 3))] * 40
    rows = sharding.shard_records(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    sizes = check(rows, texts)
    assert max(sizes.values()) < 1.05 * sum(sizes.values()) / 8 and min(sizes.values()) > 0.95 * sum(sizes.values()) / 8
    groups = defaultdict(set)
    for r in rows:
        if r["doc_id"] < 1500:
            groups[r["text_crc32"]].add(r["shard"])
    assert all(len(g) == 1 for g in groups.values())


def test_odd_rows(spark, tmp_path):
    df, rows = odd_documents(spark)
    check(sharding.shard_records(df).collect(), rows)
    assert sharding.shard_records(empty_documents(spark)).collect() == []
    sharding.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == set(df.columns)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows)


@pytest.mark.parametrize("bounds", [[], [5], [-3, 0, 7, 7, 100], list(range(0, 2000, 3))])
def test_range_index(spark, bounds):
    values = [-10, -3, -1, 0, 5, 7, 99, 100, 5000, None]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", range_index(F.col("v"), bounds).alias("i")).collect()
    assert [r["i"] for r in got] == [0 if v is None else sum(b <= v for b in bounds) for v in values]
