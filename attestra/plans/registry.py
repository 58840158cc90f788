"""Query registry: a builder, the survey rows it covers and, where SQL can say it, the equal SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import widen

QUERIES: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[["Tables"], DataFrame]
    sql: str | None


class Tables:
    """Lazy access to the parquet tables of one directory."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def wide(self, name: str, *columns) -> DataFrame:
        """Selected columns of a table, spread for CPU-heavy row work."""
        return widen(getattr(self, name).select(*columns))

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, covers: str, sql: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, covers, build, sql)
        return build
    return register
