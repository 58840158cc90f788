"""Session settings the jobs rely on, and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A rule folder of more files than this is no configuration and is refused.
DIMENSION_ROW_LIMIT = 50_000


def build_session(app: str = "attestra", master: str | None = None, cores: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:  # on a cluster the number of shuffle partitions comes from its own configuration
        builder = builder.config("spark.sql.shuffle.partitions", str(cores)).master(master).config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder of the cluster; a private one only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-attestra-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs whose result is stored leave no shuffle files behind; otherwise these stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iterative result in the shared folder so lost executors can recover it."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Materialise a large result as columns in the shared folder: repeated values take little room and readers read only what they use."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan over the cores before heavy per-row parsing; a scan whose rows are spread already is left alone.

    A file is split by bytes but read by row groups, so many splits may be empty. Counting rows reads no column.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= cores:
        filled = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        if (filled["most"] or 0) * cores <= 1.5 * (filled["all"] or 0):
            return df
    return df.repartition(max(cores, splits))
