"""The corpus pipeline: documents through quality, near-duplicate and substring stages into packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and reads
back as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import packing, quality, simhash, spans
from attestra.llm.queries import WORD_TOKENIZER, vocabulary
from attestra.session import shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is below the threshold; the trees are fitted on labelled rows of docs.

    A null text scores as an empty one, repeated rows score alike and all stay or go; columns of any name keep their values.
    """
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = f"score-{uuid.uuid4().hex}"  # docs may have a column of any fixed name
    return quality.scored(docs, forest, name=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of every component of texts whose five-word shingles overlap by 0.8 or more.

    Null and empty texts are one component, null ids come last, and of rows equal in id and text one stays.
    """
    return simhash.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes sentences that an earlier document has as part of the same run; n_chars follows the text."""
    cut = spans.remove_repeated(docs, every_end=True).drop("removed_spans")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens over all that is left."""
    return packing.pack_documents(docs, vocabulary(WORD_TOKENIZER))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", one_of_each_group),
    ("substring dedup", without_repeats),
    ("packing", packed),
]

# Trained trees, hashes of fingerprints and token ids are beyond SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
