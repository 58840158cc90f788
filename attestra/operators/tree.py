"""Section tree of a corpus: flat nodes with parent keys, leaf counts and a sort key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .judgement import severity, severity_name


def tree_nodes(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """One node per open section that holds at least one leaf, with the worst status below it.

    `leaves` carries `path` (open sections, outermost first) and a status. Sections without leaves do
    not appear. The sort key orders numbers part by part ('1.10' after '1.2').
    """
    steps = F.transform("path", lambda p, i: F.struct(
        p["pos"].alias("node"), p["number"].alias("number"), p["title"].alias("title"), (i + 1).alias("level"),
        F.when(i > 0, F.get("path", i - 1)["pos"]).alias("parent")))
    rows = leaves.select(*keys, "status", F.explode(steps).alias("n")).select(*keys, "status", "n.*")
    padded = F.array_join(F.transform(F.split("number", r"\."), lambda x: F.lpad(x, 6, "0")), ".")
    return rows.groupBy(*keys, "node", "parent", "number", "title", "level").agg(
        F.count(F.lit(1)).alias("leaves"), severity_name(F.max(severity(F.col("status")))).alias("status")).withColumn("sort_key", padded)
