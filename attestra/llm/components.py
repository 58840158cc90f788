"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Columns (node, root): every node that an edge names and one node that stands for its component.

    Each round every node moves to the neighbour (or itself) of lowest priority and edges follow. Priorities are
    hashed anew per round, so chains in id order shrink by a constant factor too and the number of rounds grows
    with the logarithm of the longest path. Rounds are stored in the shared folder; no edge reaches the driver.
    Null ends and loops are ignored.
    """
    edges = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("p"), "b")).alias("best"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("p"), F.col("a").alias("b"))
        moved = stored(best.select(F.col("a").alias("node"), F.least("best", own)["b"].alias("to")))
        if labels is None:
            labels = moved.withColumnRenamed("to", "root")
        else:
            step = moved.select(F.col("node").alias("root"), F.col("to"))
            labels = stored(labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        ends = moved.select(F.col("node").alias("a"), F.col("to").alias("x"))
        far = moved.select(F.col("node").alias("b"), F.col("to").alias("y"))
        shifted = edges.join(ends, "a").join(far, "b").where("x <> y")
        edges = stored(shifted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
