"""The pipeline: every stage against a brute-force version of it, on what the stage before left."""

import uuid

import numpy as np
import pandas as pd
from helpers import empty_documents, odd_documents
from test_packing import check
from test_simhash import slow_groups
from test_spans import slow

import corpus_pipeline
from attestra.llm import quality
from attestra.session import shared_folder


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps = [f for _, f in corpus_pipeline.STAGES]
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    forest = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    good = forest.score(quality.table_of(pd.Series([r["text"] for r in rows]))) >= quality.THRESHOLD
    rows = [r for r, keep in zip(rows, good) if keep]
    left = steps[0](spark, docs, small)
    assert left.columns == docs.columns and sorted((r.asDict() for r in left.collect()), key=lambda r: r["doc_id"]) == rows
    names = slow_groups([r["text"] for r in rows])
    rows = [r for k, r in enumerate(rows) if names[k] == k]
    left = steps[1](spark, left, small)
    assert left.columns == docs.columns and sorted((r.asDict() for r in left.collect()), key=lambda r: r["doc_id"]) == rows
    texts = slow([(r["doc_id"], r["text"]) for r in rows], every_end=True)
    rows = [r | {"text": t, "n_chars": len(t)} for r, t in zip(rows, texts)]
    left = steps[2](spark, left, small)
    assert left.columns == docs.columns and left.schema == docs.schema
    assert sorted((r.asDict() for r in left.collect()), key=lambda r: r["doc_id"]) == rows
    check(steps[3](spark, left, small).collect(), [(r["doc_id"], r["text"]) for r in rows])
    check(corpus_pipeline.run(spark, small).collect(), [(r["doc_id"], r["text"]) for r in rows])


def test_odd_rows(spark):
    folder = f"{shared_folder(spark)}/odd-{uuid.uuid4().hex}"
    spark.createDataFrame([(k, k % 2, 0) for k in range(1, 11)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for docs in (odd_documents(spark)[0], empty_documents(spark)):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            if number < 3:
                assert out.columns == docs.columns
                out.write.mode("overwrite").parquet(f"{folder}/{number}")
                docs = spark.read.parquet(f"{folder}/{number}")
            else:
                assert np.isfinite([r["length"] for r in out.collect()]).all()
