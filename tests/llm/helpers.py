"""Fixtures that every operator of the package has to stand: nulls, empties, long texts, ties, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, sentences: int) -> str:
    dice = random.Random(seed)
    return " ".join(" ".join(dice.choice(WORDS) + str(dice.randrange(50)) for _ in range(dice.randrange(5, 15))).capitalize() + "." for _ in range(sentences))


def odd_documents(spark):
    """Null and empty texts, null keys, repeated rows, repeated keys, one long text, and columns named like internal ones."""
    long = prose(1, 2500)
    rows = [(1, prose(2, 8)), (2, None), (3, ""), (4, "  \n\t "), (5, long), (6, prose(2, 8)), (None, prose(3, 6)), (7, prose(4, 9)), (7, prose(4, 9)),
            (8, prose(5, 3)), (8, prose(6, 3)), (9, "word"), (10, "Ünï çode 漢字 \x1c\x85 <|endoftext|> <|startoftext|>x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"),
                     *[F.lit(0).alias(c) for c in ("_key", "_rid", "_row", "fp", "score_", "block", "shard", "slot", "place", "key", "h", "node")]), rows


def empty_documents(spark):
    return odd_documents(spark)[0].limit(0)
