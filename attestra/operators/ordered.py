"""Order-dependent steps that stay distributed when one key holds a large share of the rows.

A plain window puts all rows of a key into one task. Here rows are first cut into blocks of their
order column; the window runs inside (key, block), and one summary row per block carries the state
across blocks. Only the summaries are ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_ROWS = 4096
# Rows of a key that one task may put in order by itself; only keys of more rows need blocks.
WHOLE_ROWS = 1 << 16


def block_of(position: Column, size: int = BLOCK_ROWS) -> Column:
    return F.floor(position / size).cast("bigint")


def by_size(df: DataFrame, keys: list[str], counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys of at most WHOLE_ROWS rows, and those of larger keys, or None where no key is larger.

    Rows of a small key can be ordered by a plain window: one exchange for any number of steps. counts: keys and n, at least the
    number of rows of each key; without it they are counted.
    """
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    crowded = cut_lineage(counts.where(F.col("n") > WHOLE_ROWS).select(*keys))
    if crowded.isEmpty():
        return df, None
    return df.join(crowded, keys, "left_anti"), df.join(crowded, keys, "left_semi")


def _inside(keys: list[str], block: str, order: list[str]):
    return Window.partitionBy(*keys, block).orderBy(*order)


def _across(keys: list[str], block: str):
    return Window.partitionBy(*keys).orderBy(block)


def range_blocks(df: DataFrame, keys: list[str], order: list[str], name: str = "block", parts: int | None = None) -> DataFrame:
    """Blocks for orders without a dense position (event times): rows are range-partitioned by key and order.

    The cut points are sampled, so a hot key is split into even parts however its rows are spread. The result
    is stored in the shared folder, which fixes the block of every row even when executors are lost later.
    """
    count = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *keys, *order)
    return cut_lineage(ranged.withColumn(name, F.spark_partition_id().cast("bigint")))


def running_last(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Latest non-null value at or before each row."""
    return running_lasts(df, keys, block, order, {name: value})


def running_lasts(df: DataFrame, keys: list[str], block: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Several running values in one pass over the rows."""
    rows = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    tails = rows.groupBy(*keys, block).agg(*[
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_t_{n}") for n in values])
    before = _across(keys, block).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, block, *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values])
    window = _inside(keys, block, order)
    inner = rows.withColumns({f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(window) for n in values})
    out = inner.join(carried, [*keys, block]).withColumns({n: F.coalesce(f"_i_{n}", f"_c_{n}") for n in values})
    return out.drop(*[f"_{k}_{n}" for n in values for k in "vic"])


def running_sum(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Sum of the values up to and including each row."""
    rows = df.withColumn("_v", value)
    sums = rows.groupBy(*keys, block).agg(F.sum("_v").alias("_sum"))
    before = _across(keys, block).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, block, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    return (rows.withColumn("_inner", F.sum("_v").over(_inside(keys, block, order))).join(carried, [*keys, block])
            .withColumn(name, F.col("_inner") + F.col("_carry")).drop("_v", "_inner", "_carry"))


def row_numbers(df: DataFrame, keys: list[str], block: str, order: list[str], name: str) -> DataFrame:
    """1, 2, 3 ... per key in the given order."""
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    before = _across(keys, block).rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(*keys, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    return (df.withColumn("_inner", F.row_number().over(_inside(keys, block, order))).join(carried, [*keys, block])
            .withColumn(name, F.col("_inner") + F.col("_carry")).drop("_inner", "_carry"))


def neighbour(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, name: str,
              following: bool = False) -> DataFrame:
    """Value of the previous (or following) row of the key; null at its end."""
    rows = df.withColumn("_v", F.struct(value.alias("v")))
    pick = F.min_by if following else F.max_by
    edge = rows.groupBy(*keys, block).agg(pick("_v", F.struct(*order)).alias("_edge"))
    across = _across(keys, block)
    step = F.lead("_edge").over(across) if following else F.lag("_edge").over(across)
    carried = edge.select(*keys, block, step.alias("_carry"))
    window = _inside(keys, block, order)
    inner = F.lead("_v").over(window) if following else F.lag("_v").over(window)
    return (rows.withColumn("_inner", inner).join(carried, [*keys, block])
            .withColumn(name, F.coalesce("_inner", "_carry")["v"]).drop("_v", "_inner", "_carry"))
