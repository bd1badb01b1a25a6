"""Cut the lineage of a frame inside a driver loop, and deal its rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from synthmill.functions.scratch import scratch, shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared folder; survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: what several uses read is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task whose work is rendering texts or making files.
DEALT = 1 << 14


def dealt(df: DataFrame, rows: int, by: str) -> DataFrame:
    """``df`` of so many rows in as many tasks as the session has cores, and in more where one would get more than DEALT.

    Adaptive execution joins shuffled partitions by their bytes, and narrow rows are the work of many tasks.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // DEALT)), by)
