"""Connected components of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from synthmill.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v) reaches.

    A round maps every node to its smallest neighbour (or itself) and the edges with them; loops and repeats vanish.  The
    smallest node of a component always stays, and all others that touch a smaller one go, so rounds are few.  Each round
    is written to the shared folder; only counts come to the driver.
    """
    maps: list[DataFrame] = []
    edges = written(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("to")), "contracted")
        maps.append(to)
        left, right = to.select("u", F.col("to").alias("a")), to.select(F.col("u").alias("v"), F.col("to").alias("b"))
        moved = edges.join(left, "u").join(right, "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        edges = written(moved.filter("u <> v").distinct(), "edges")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    # Every node takes part in the first round; later rounds name the survivors of the one before.
    out = maps[0].select(F.col("u").alias("node"), F.col("to").alias("component"))
    for to in maps[1:]:
        step = to.select(F.col("u").alias("component"), "to")
        out = out.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return out
