"""Sinks: per-stage results, summaries with totals, run log and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.reports import new_runs


def write_stages(evaluations: DataFrame, path: str) -> None:
    """One folder of CSV files per stage; rows stay in the partitions they are in, so no stage passes through one task."""
    evaluations.write.mode("overwrite").partitionBy("stage").option("header", True).csv(path)


def write_summary(counts: DataFrame, path: str) -> None:
    """Counts with their totals row; the result has one row per stage, so one file is enough."""
    counts.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Append the runs the log does not hold yet."""
    spark = runs.sparkSession
    history = spark.read.schema(runs.schema).parquet(path) if _exists(spark, path) else runs.limit(0)
    new_runs(runs, history).write.mode("append").parquet(path)


def write_audit(results: DataFrame, path: str) -> None:
    """Full results as JSON, one folder per run; earlier runs stay in place."""
    results.write.mode("append").partitionBy("run_id").json(path)


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
