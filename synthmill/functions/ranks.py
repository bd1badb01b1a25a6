"""Ranks over groups of any size.

A plain window sends a whole group to one task.  Here a group is cut into chunks of consecutive
row ids: each chunk is ranked on its own, and the sizes of the earlier chunks (one small row per
group and chunk) are added.  A chunk never holds more than ``chunk`` rows, because row ids are
distinct whole numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from synthmill.functions.draws import div

CHUNK = 1 << 20


def grouped_rank(df: DataFrame, group: Sequence[str], row: str, name: str = "rank", chunk: int = CHUNK) -> DataFrame:
    """Add the 1-based rank of each row among the rows of its group, by row id."""
    # Group keys in a form without NULLs, so that the join below is a plain one and finds both sides
    # already partitioned by it: the data moves once.
    parts = {}
    for i, column in enumerate(group):
        parts[f"__k{i}"] = F.coalesce(F.col(column).cast("string"), F.lit(""))
        parts[f"__n{i}"] = F.col(column).isNull()
    groups, keys = list(parts), [*parts, "__chunk"]
    # Row ids of one chunk may be sparse; they are still at most ``chunk`` rows.
    cut = df.withColumns({**parts, "__chunk": div(F.col(row).cast("long"), chunk)})
    sizes = cut.groupBy(*keys).agg(F.count("*").alias("__size"))
    earlier = W.partitionBy(*groups).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__offset"))
    local = F.row_number().over(W.partitionBy(*keys).orderBy(row))
    joined = cut.withColumn("__local", local).join(offsets, keys)
    return joined.select(*df.columns, (F.col("__local") + F.col("__offset")).cast("long").alias(name))


def row_index(df: DataFrame, row: str, name: str = "index", chunk: int = CHUNK) -> DataFrame:
    """Add the dense 0-based position of each row by row id."""
    ranked = grouped_rank(df.withColumn("__all", F.lit(0)), ["__all"], row, name, chunk)
    return ranked.withColumn(name, F.col(name) - 1).drop("__all")
