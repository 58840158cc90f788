"""Multi-index hashing: complete within the radius, recall against brute force, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from attestra.llm import mih
from attestra.llm.queries import QUERIES


def brute(keys, vectors, k=5):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in [n for n, key in enumerate(keys) if key % 50 == 0]:
        score = unit @ unit[q]
        out[keys[q]] = sorted((-s, key) for s, key in zip(score, keys) if key != keys[q])[:k]
    return out


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    wanted = brute([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=float))
    got = QUERIES["op6_neighbours"](spark, small).collect()
    assert len(got) == 5 * len(wanted)
    hits = sum(r["vec_id"] in [key for _, key in wanted[r["query_id"]]] for r in got)
    assert hits >= 0.9 * len(got)
    for query in wanted:
        own = sorted((r for r in got if r["query_id"] == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert own == sorted(own, key=lambda r: (-r["score"], r["vec_id"]))


def test_index_is_complete():
    codes = np.random.default_rng(2).integers(0, 1 << 16, (800, 4), dtype=np.uint16)
    index = mih.Index(codes)
    for radius in (0, 3, 17, 25, 40):
        for n in range(0, 800, 40):
            apart = np.bitwise_count(codes ^ codes[n]).sum(axis=1, dtype=int)
            assert np.array_equal(index.within(codes[n], radius), np.flatnonzero(apart <= radius))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mih, "BLOCK_ROWS", 40)
    monkeypatch.setattr(mih, "QUERY_ROWS", 2)
    random = np.random.default_rng(4)
    rows = [(k, [float(x) for x in random.normal(size=8)]) for k in range(1, 200)]
    same = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    rows += [(301 + k, same) for k in range(9)] + [(250, same), (250, same)]
    bad = [(400, None), (450, [0.0] * 8), (500, [float("nan")] * 8), (550, [1.0, None] * 4), (600, [float("inf")] * 8), (650, [1.0]), (None, same), (700, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").select("*", *[F.lit(0).alias(c) for c in ("key", "v", "b", "q", "rank", "score")])
    got = mih.search(df, df.where("vec_id % 50 = 0")).collect()
    assert {r["query_id"] for r in got} == {50, 100, 150, 250}
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 250), key=lambda r: r["rank"])] == [301, 302, 303, 304, 305]
    assert not {r["vec_id"] for r in got} & {b[0] for b in bad}
    assert all(sum(r["query_id"] == q for r in got) == 5 for q in (50, 100, 150))
    few = df.where("vec_id in (50, 100, 3)")
    assert sorted((r["query_id"], r["rank"]) for r in mih.search(few, few.where("vec_id % 50 = 0")).collect()) == [(50, 1), (50, 2), (100, 1), (100, 2)]
    one = df.where("vec_id = 50")
    assert mih.search(one, one).collect() == [] and mih.search(df.limit(0), df.limit(0)).collect() == []
