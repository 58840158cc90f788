"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder

# Rows and bytes sent to a Python worker at once. Texts may be long, so a batch stays far below Spark's 10,000 rows.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers on long texts; smaller values set by the user are kept."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(name))  # a size with another unit was set by the user
        if now and not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))


def carried(key: str) -> Column:
    """A key as it passes through pandas: as text, since pandas would turn whole numbers beside nulls into floats."""
    return F.col(key).cast("string")


def restored(docs: DataFrame, key: str, name: str) -> Column:
    """The carried key `name` in the type that `key` has in docs."""
    return F.col(name).cast(docs.schema[key].dataType)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so lost executors can recover it."""
    return cut_lineage(df)


def tabled(df: DataFrame) -> DataFrame:
    """Like stored, but as a Parquet table, which computes the rows once; their order and partitions are not kept."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_index(value: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending bounds are at or below the value (binary search; null: 0)."""
    if not bounds:
        return F.lit(0)
    depth = len(bounds).bit_length()
    table = F.lit(list(bounds)).cast("array<bigint>")

    def step(at: Column, width: Column) -> Column:
        ahead = at + width
        inside = (ahead <= len(bounds)) & (F.get(table, ahead - 1) <= value)
        return F.when(inside, ahead).otherwise(at)

    widths = F.array(*[F.lit(1 << k) for k in reversed(range(depth))])
    return F.aggregate(widths, F.lit(0), step)


def splitters(rows: DataFrame, key: str, size: str, row: str, total: int, ranges: int, samples: int = 32) -> list[int]:
    """At most ranges - 1 ascending keys that cut the key order into ranges of about equal size.

    They are quantiles of a sample that takes a row with a chance in proportion to its size, drawn by the hash of its
    row id, so it is the same at every run; about `samples` rows a range.
    """
    if ranges < 2:
        return []
    chance = F.col(size) * F.lit(ranges * samples / max(1, total))
    draw = F.pmod(F.xxhash64(row, F.lit("draw")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    quantiles = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = rows.where(draw < chance).agg(F.percentile_approx(key, quantiles, F.lit(10 * ranges)).alias("cuts")).first()["cuts"]
    return sorted({c for c in cuts or [] if c is not None})
