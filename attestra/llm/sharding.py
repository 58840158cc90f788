"""Sharding by sampled splitters, in DataFrame operations only.

A size-weighted sample of keys gives quantile boundaries, which cut the key order into many ranges of about equal
bytes. Ranges found overfull are subdivided: between keys by the width of the range, and inside a key that is heavy by
itself by row. Contiguous ranges then make up shards of near-equal bytes, and slots follow from counts per range.
The key is a hash of the text, so equal texts stay together unless their group is heavy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import range_index, splitters, stored, text_of

RANGES_PER_SHARD = 128
# Beyond this many bytes in a range there are more ranges, so a task of the numbering stays small at any scale.
RANGE_BYTES = 1 << 30


def assign(rows: DataFrame, shards: int, key: str = "_g", size: str = "size", row: str = "_id") -> DataFrame:
    """The stored rows with `shard` and `slot`; key and row are longs, row is unique, size is positive."""
    measured = rows.agg(F.sum(size).alias("bytes")).first()
    total = measured["bytes"] or 1
    ranges = max(shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES))
    target = total / ranges
    bounds = splitters(rows, key, size, row, total, ranges)
    ranged = rows.withColumn("_range", range_index(F.col(key), bounds))
    # One row per range at most, so it can be sent to every task.
    overfull = (ranged.groupBy("_range").agg(F.sum(size).alias("_bytes"), F.min(key).alias("_low"), F.max(key).alias("_high"))
                .where(F.col("_bytes") > 2 * target).withColumn("_parts", F.ceil(F.col("_bytes") / target)))
    marked = ranged.join(F.broadcast(overfull), "_range", "left")
    # Keys above the target number no more than the ranges.
    heavy = (marked.where("_parts is not null").groupBy(key).agg(F.sum(size).alias("_own")).where(F.col("_own") > target)
             .select(key, F.lit(True).alias("_heavy")))
    width = (F.col("_high").cast("double") - F.col("_low").cast("double")) + 1.0
    between = F.floor((F.col(key).cast("double") - F.col("_low").cast("double")) / width * F.col("_parts"))
    inside = F.pmod(F.xxhash64(row), F.col("_parts"))
    part = F.when(F.col("_parts").isNull(), 0).when(F.col("_heavy"), inside).otherwise(between)
    placed = marked.join(F.broadcast(heavy), key, "left").withColumn("_part", part.cast("bigint"))
    units = placed.groupBy("_range", "_part").agg(F.sum(size).alias("_unit"), F.count(F.lit(1)).alias("_rows"))
    order = Window.orderBy("_range", "_part")
    middle = F.sum("_unit").over(order) - F.col("_unit") / 2
    units = units.withColumn("shard", F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int"))
    within = Window.partitionBy("shard").orderBy("_range", "_part")
    units = units.withColumn("_first", F.sum("_rows").over(within) - F.col("_rows")).select("_range", "_part", "shard", "_first")
    number = F.row_number().over(Window.partitionBy("_range", "_part").orderBy(key, row))
    out = placed.withColumn("_number", number).join(F.broadcast(units), ["_range", "_part"])
    return (out.withColumn("slot", F.col("_first") + F.col("_number") - 1)
            .drop("_range", "_part", "_parts", "_bytes", "_low", "_high", "_heavy", "_first", "_number"))


def _prepared(docs: DataFrame, text: str, *columns) -> DataFrame:
    whole = text_of(text)
    return stored(docs.select(
        *columns, (F.octet_length(whole).cast("long") + 1).alias("size"), F.crc32(F.encode(whole, "utf-8")).alias("text_crc32"),
        F.xxhash64(whole).alias("_g"), F.monotonically_increasing_id().alias("_id")))


def shard_records(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard of every row; other columns are dropped.

    The law is `bytes`: a shard differs from an even share by a range or, where that is larger, a record. Null texts count as
    empty (size 1); repeated rows are separate records; keys may be null. An empty table gives an empty result.
    """
    rows = _prepared(docs, text, F.col(key).alias("_key"))
    return assign(rows, shards).select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, text: str = "text", shards: int = 8) -> None:
    """Write whole records as Parquet, a folder per shard, each record with its slot.

    Input columns named shard or slot are replaced.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = _prepared(docs, text, F.struct(*columns).alias("_record"))
    assign(rows, shards).select("_record.*", "shard", "slot").write.partitionBy("shard").parquet(path)
