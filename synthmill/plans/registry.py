"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Rows of a table that one task takes, about.
ROWS = 1 << 18


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is checked for rows only (and by the tests)."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out to all cores of the session, and to more tasks where these would hold more than ROWS rows each.

    Queries compute wide columns from narrow rows, so a split of a small or well packed file would be the work of many
    tasks, and its sorts and part files would grow with the table.  The rows are counted from the files' footers.  A table
    of enough splits is read as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    splits = df.rdd.getNumPartitions()
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS)) if splits else 0
    return df.repartition(tasks) if splits < tasks else df
