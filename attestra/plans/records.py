"""Test records written as text from numeric columns: the texts must be parsed back by the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# Numeric side of the same records, for the SQL that checks the parsed side.
REC_SQL = """
rec AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, p_size AS s,
         l_suppkey % 5 AS n, l_shipdate, l_returnflag, l_linestatus, l_extendedprice
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def by_line(*texts) -> F.col:
    out = None
    for number, text in enumerate(texts, start=1):
        here = F.col("l_linenumber") == number
        out = F.when(here, text) if out is None else out.when(here, text)
    return out


def records(t: Tables) -> DataFrame:
    """doc = order, record = line: criterion from the part size, result from the quantity in five notations."""
    base = (
        t.wide("lineitem", *KEYS, F.col("l_quantity").cast("bigint").alias("q"), "l_shipdate", "l_returnflag",
               "l_linestatus", "l_extendedprice")
        .join(t.part.select("p_partkey", F.col("p_size").alias("s")), F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("n", F.col("l_suppkey") % 5)
    )
    q, s, n = F.col("q"), F.col("s"), F.col("n")
    criteria = by_line(
        F.concat(s, F.lit(" mg 이하")),
        F.concat(F.lit("≥ "), s, F.lit(" mg")),
        F.concat(s, F.lit(".0~"), s + 20, F.lit(".0 mg")),
        F.concat(s, F.lit(" x 10^3 cells/mL 미만")),
        F.concat(F.lit("기준("), s, F.lit(" ㎍/mL) 초과")),
        F.concat(s, F.lit("")),
        F.lit("별도 규정에 따름"),
    )
    unit = by_line(*[F.lit(u) for u in ("mg", "mg", "mg", "cells/mL", "μg/mL", "mg", "mg")])
    big = F.col("l_linenumber") == 4
    scaled = F.when(big, q * 1000).otherwise(q)
    result = (
        F.when(n == 0, F.when(big, F.concat(q, F.lit(" x 10^3 cells/mL"))).otherwise(F.concat(q, F.lit(" "), unit)))
        .when(n == 1, F.concat(F.lit("측정값 "), scaled, unit))
        .when(n == 2, F.when(big, F.concat(q, F.lit(" × 10³ "), unit)).otherwise(F.concat(q, F.lit(".0 x 10⁰ "), unit)))
        .when(n == 3, scaled.cast("string"))
        .otherwise(F.concat(q, F.lit(" IU/mL")))
    )
    return base.withColumns({"criteria": criteria, "result": result})
