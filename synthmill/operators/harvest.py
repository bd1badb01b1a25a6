"""Learned values on their way into the bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from synthmill.functions.kinds import trim
from synthmill.operators import infer as I
from synthmill.schema import Schema


def harvest_run(run: DataFrame, row: str, schema: Schema, cap: int) -> DataFrame:
    """(category, key_name, value) of generated leaves, without tied paths, up to ``cap`` rows.

    The cap follows row order; it is a bounded top-k over the run, not a sort of it.
    """
    tied = {p.lower() for p in schema.tied_paths}
    keys = {path: f.write_key(path) for path, f in schema.leaves() if path.lower() not in tied}
    rows = I.leaves(run, row).where(F.col("kind") == I.VALUE)
    key = F.try_element_at(F.create_map(*[F.lit(x) for pair in keys.items() for x in pair]), I.path_of(F.col("steps")))
    named = rows.select("pos", "at", key.alias("key_name"), trim(F.col("value")).alias("value"))
    kept = named.where(F.col("key_name").isNotNull() & (F.col("value") != ""))
    return kept.orderBy("pos", "at").limit(cap).select(F.col("key_name").alias("category"), "key_name", "value")


def learned_rows(values: DataFrame) -> DataFrame:
    """Harvested (path, value) rows in the form the bank takes."""
    return values.select(F.col("path").alias("category"), F.col("path").alias("key_name"), "value",
                         F.substring_index("path", ".", -1).alias("source_key"))
