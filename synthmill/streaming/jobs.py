"""The batch jobs on unbounded input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from synthmill.operators.generate import generate_for
from synthmill.operators.pools import Pools
from synthmill.schema import Schema
from synthmill.streaming.bank_runs import bank_merger


def generate_stream(spark: SparkSession, schema: Schema, seed: int, rows_per_second: int = 1000, *,
                    rows: DataFrame | None = None, row: str = "value", keep: tuple[str, ...] = ("timestamp",),
                    pools: Pools | None = None, **source) -> DataFrame:
    """Endless records; row ``i`` of the stream equals row ``i`` of a batch run with the same seed.

    Rows come from a clock, or from a stream ``rows`` with whole-number ids in ``row``; ``keep`` passes columns through.
    ``pools`` are the bank values of a batch run; large ones are joined with each micro-batch and keep no state.
    """
    if rows is None:
        rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).options(**source).load()
    named = rows.select(*keep, F.col(row).alias("row"))
    return generate_for(named, "row", schema, seed, keep=[*keep, "row"], pools=pools)


def bank_stream(rows: DataFrame, folder: str, checkpoint: str, now: Column, *, ensure: bool = False, trigger: dict | None = None,
                **kept):
    """Add a stream of (category, key_name, value[, used_at]) rows to the bank of a folder; ``kept`` goes to ``bank_merger``."""
    return (rows.writeStream.foreachBatch(bank_merger(folder, now, ensure, **kept)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def first_seen_stream(values: DataFrame, time: str | None = None, delay: str | None = None,
                      keys: tuple[str, ...] = ("path", "value")) -> DataFrame:
    """First row of each (path, value), however late a row comes: the state holds every pair that has been seen.

    A state of that size wants Spark's RocksDB store.  With ``time`` and ``delay`` a watermark bounds it instead; rows later
    than that are dropped, and a pair counts again after it.
    """
    if delay is None:
        return values.dropDuplicates(list(keys))
    return values.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
