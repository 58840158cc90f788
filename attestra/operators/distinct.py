"""Work on the distinct texts of a table instead of on its rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# A dictionary within both bounds is sent to every executor; a larger one meets the rows by a merge join.
SENT_TEXTS = 100_000
SENT_BYTES = 8 << 20


def once_per_text(rows: DataFrame, texts: list[str], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with the columns that `build` adds to the distinct values of `texts`.

    Criteria, results, titles and dates repeat from record to record, so expensive expressions run once per distinct value, however
    many rows write it. `build` keeps `texts` and one row per value; its result is stored and joined back, nulls included.
    """
    spark = rows.sparkSession
    # few texts are few bytes, which adaptive execution would put into one task however long each takes
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = cut_lineage(build(rows.select(*texts).distinct().repartition(parts, *texts)))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))).alias("b")).first()
    small = size["n"] <= SENT_TEXTS and (size["b"] or 0) <= SENT_BYTES
    named = {c: f"_text_{i}" for i, c in enumerate(texts)}
    known = known.withColumnsRenamed(named).hint("broadcast" if small else "merge")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()])
    return rows.join(known, same, "left").drop(*named.values())


def per_text(rows: DataFrame, texts: list[str], columns: dict[str, Column]) -> DataFrame:
    """`rows.withColumns(columns)` for expressions of `texts` alone, evaluated once per distinct value."""
    replaced = [c for c in columns if c in rows.columns]
    return once_per_text(rows.drop(*replaced), texts, lambda known: known.select(*texts, *[c.alias(n) for n, c in columns.items()]))
