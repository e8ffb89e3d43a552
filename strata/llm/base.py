"""Registry of this folder's queries and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.session import Scratch, ship, tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Rows of long texts or arrays: an Arrow batch of so many stays within a worker's memory.
BATCH_ROWS = "256"


def ready(spark: SparkSession) -> SparkSession:
    """The settings and the package that every operator here relies on."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return ship(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Query]:
    """Register ``fn(spark, folder, scratch)``; its written tables stay until the session ends."""

    def register(fn: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ready(spark)
            return fn(spark, folder, Scratch(spark))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return register
