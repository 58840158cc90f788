"""Incremental intake: ledgers that make repeated deliveries harmless, and the latest status per document.

Every micro-batch writes its own folder and overwrites it when the batch is repeated after a failure, so a
lost executor or a restarted query never counts a row twice. Ledgers never expire; they hold keys, not contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def attachment_key(uid: Column, index: Column, name: Column, digest: Column) -> Column:
    """The same file in a new message is a new submission: identity is message, position, name and content."""
    return F.sha1(F.concat_ws("::", *[F.coalesce(c.cast("string"), F.lit("")) for c in (uid, index, name, digest)]))


def checked_key(uid: Column, mailbox: str, search: str, keyword: str) -> Column:
    """A changed query checks its messages again."""
    return F.sha1(F.concat_ws("::", F.coalesce(uid.cast("string"), F.lit("")), F.lit(mailbox), F.lit(search), F.lit(keyword)))


def read_ledger(spark: SparkSession, path: str, schema, before_batch: int | None = None) -> DataFrame:
    """Rows of a ledger; during a batch only the rows of earlier batches count."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    return rows if before_batch is None else rows.where(F.col("batch") < before_batch)


def keep_new(stream: DataFrame, ledger: str, checkpoint: str, key: str = "key", order: str = "arrived"):
    """Start a query that appends the first row of every key the ledger does not know yet."""
    schema = stream.schema

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        others = [c for c in batch.columns if c != key]
        first = batch.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("r")).select(key, *[F.col(f"r.{c}") for c in others])
        known = read_ledger(spark, ledger, schema, batch_id).select(key)
        fresh = first.join(known, key, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest(stream: DataFrame, folder: str, checkpoint: str, key: str = "doc_id", order: str = "updated_at", compact_every: int = 20):
    """Start a query that maintains the latest row per key.

    A batch writes only its own latest rows; every `compact_every` batches a full version is written. A folder
    counts for readers only once it is complete, so they see whole batches in order.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest_rows(batch, key, order).write.mode("overwrite").parquet(f"{folder}/delta={batch_id}")
        if batch_id and batch_id % compact_every == 0:
            whole = current_version(spark, folder, batch.schema, key, order, upto=batch_id)
            whole.write.mode("overwrite").parquet(f"{folder}/base={batch_id}")
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    others = [c for c in rows.columns if c not in (key, order)]
    newest = rows.groupBy(key).agg(F.max(F.struct(order, *others)).alias("r"))
    return newest.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def current_version(spark: SparkSession, folder: str, schema, key: str = "doc_id", order: str = "updated_at", upto: int | None = None) -> DataFrame:
    """Latest row per key from the newest full version and the batches after it."""
    bases, deltas = _complete(spark, folder, "base", upto), _complete(spark, folder, "delta", upto)
    start = max((b for b in bases if upto is None or b < upto), default=-1)
    paths = [f"{folder}/base={start}"] if start >= 0 else []
    paths += [f"{folder}/delta={d}" for d in deltas if d > start]
    if not paths:
        return spark.createDataFrame([], schema)
    return latest_rows(spark.read.schema(schema).parquet(*paths), key, order)


def _complete(spark: SparkSession, folder: str, kind: str, upto: int | None) -> list[int]:
    """Numbers of the finished folders of a kind."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    pattern = path(f"{folder}/{kind}=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    numbers = [int(s.getPath().getParent().getName().split("=")[1]) for s in found]
    return sorted(n for n in numbers if upto is None or n <= upto)
