"""A bank that grows by micro-batches, kept as sorted-out runs instead of one snapshot per batch.

A folder holds ``run=<first>.<last>/bucket=<k>``: what the batches ``first`` to ``last`` did to the values of bucket ``k``.
Uses add up and times have a least and a greatest, so runs may be merged in any grouping, and the bank is the sum of
them.  A batch writes its own values only.  Where a bucket has too many runs, its newest ones are merged with each
other, and with an older one only when they have grown to its size: a row is rewritten a logarithmic number of times.

Runs of a bucket are nested or apart, because a merge takes the newest ones.  Of those before a batch, the widest are
the state before it; the others can go once no batch can be repeated that started from them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from synthmill.operators.bank import BANK_COLUMNS, IDENTITY, entry_id, merge_uses, missing_values, uses

#: Buckets of a folder; it keeps the number it was begun with.
BUCKETS = 8
#: Runs of a bucket above which its newest are merged.
RUNS = 8
#: Batches whose state can still be read besides the newest, for readers that began before it.
RETAIN = 2
#: Before the first batch of a stream.
START = -1

RUN_SCHEMA = ("id string, category_id string, key_name string, value string, use_count bigint,"
              " last_used_at timestamp_ntz, created_at timestamp_ntz, bucket int")


@dataclass(frozen=True)
class Run:
    """Bytes of one bucket of one run."""

    first: int
    last: int
    bucket: int
    size: int

    def path(self, folder: str) -> str:
        return f"{folder}/run={self.first}.{self.last}/bucket={self.bucket}"


def _files(spark: SparkSession, folder: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    return hadoop, root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def _spans(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """(first, last) of the complete runs."""
    hadoop, root, fs = _files(spark, folder)
    if not fs.exists(root):
        return []
    names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(root)]
    return [tuple(int(n) for n in name.removeprefix("run=").split("."))
            for name, path in names if name.startswith("run=") and fs.exists(hadoop.Path(path, "_SUCCESS"))]


def _runs(spark: SparkSession, folder: str) -> list[Run]:
    """Buckets of the complete runs; Spark lists the files, the driver gets one row for each bucket of a run."""
    spans = _spans(spark, folder)
    if not spans:
        return []
    parts = r"run=(-?[0-9]+)\.(-?[0-9]+)/bucket=([0-9]+)/"
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
             .load([f"{folder}/run={a}.{b}" for a, b in spans]))
    named = found.select(*[F.regexp_extract("path", parts, i).cast("int").alias(n)
                           for i, n in ((1, "first"), (2, "last"), (3, "bucket"))], "length")
    return [Run(*r) for r in named.groupBy("first", "last", "bucket").agg(F.sum("length")).collect()]


def state(runs: Iterable[Run], before: int = 1 << 62) -> dict[int, list[Run]]:
    """Per bucket the runs, newest first, that make up the bank before a batch."""
    chosen: dict[int, list[Run]] = defaultdict(list)
    for run in sorted(runs, key=lambda r: (-r.last, r.first)):
        own = chosen[run.bucket]
        if run.last < (own[-1].first if own else before):
            own.append(run)
    return {k: own for k, own in chosen.items() if own}


def to_merge(own: list[Run], most: int) -> list[Run]:
    """The newest of a bucket's runs that are due to be merged: none up to ``most`` runs, else at least half of them.

    An older run joins them if it is no larger than they are together.
    """
    if len(own) <= most:
        return []
    taken, size = 0, 0
    for run in own:
        if taken >= max(2, len(own) // 2) and run.size > size:
            break
        taken, size = taken + 1, size + run.size
    return own[:taken]


def _read(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], RUN_SCHEMA)
    columns = [c.strip().split()[0] for c in RUN_SCHEMA.split(",")]
    return spark.read.option("basePath", folder).schema(RUN_SCHEMA + ", run string").parquet(*paths).select(*columns)


def _write(rows: DataFrame, folder: str, first: int, last: int) -> None:
    """Rows of a run, in as few files as their number needs."""
    _stored(rows).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/run={first}.{last}")


def _stored(entries: DataFrame) -> DataFrame:
    """Entries as a run holds them: an id that follows from what it identifies is left empty."""
    own = entry_id(*[F.col(c) for c in IDENTITY])
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_used_at", "created_at")]
    return entries.select(F.nullif("id", own).alias("id"), *IDENTITY, "use_count", *times, "bucket")


def _bucketed(entries: DataFrame, buckets: int) -> DataFrame:
    return entries.withColumn("bucket", F.pmod(F.xxhash64(*IDENTITY), F.lit(buckets)).cast("int"))


def _sum(rows: DataFrame, *by: str) -> DataFrame:
    """Entries of several runs as those of one."""
    corrected = rows.where("id IS NOT NULL").select(*by, *IDENTITY, F.col("id").alias("kept"))
    return merge_uses(rows, corrected, by)


def _dropped(spark: SparkSession, folder: str, runs: list[Run], batch: int, retain: int) -> None:
    """Remove runs that no state from ``retain`` batches ago on is made of."""
    live = {r for b in range(batch - retain, batch + 2) for own in state(runs, b).values() for r in own}
    gone = [r for r in runs if r.last <= batch and r not in live]
    kept = {(r.first, r.last) for r in runs if r not in set(gone)}
    hadoop, _, fs = _files(spark, folder)
    for path in sorted({r.path(folder) if (r.first, r.last) in kept else f"{folder}/run={r.first}.{r.last}" for r in gone}):
        fs.delete(hadoop.Path(path), True)


def read_bank(spark: SparkSession, folder: str, before: int = 1 << 62) -> DataFrame | None:
    """The bank as the batches before ``before`` left it, or None if there was none."""
    spans = sorted(s for s in _spans(spark, folder) if s[1] < before)
    if not spans:
        return None
    if all(last < first for (_, last), (first, _) in zip(spans, spans[1:])):
        paths = [f"{folder}/run={a}.{b}" for a, b in spans]
    else:
        paths = [r.path(folder) for own in state(_runs(spark, folder), before).values() for r in own]
    return _sum(_read(spark, folder, paths)).select(*BANK_COLUMNS)


def start_bank(bank: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Begin a folder with an existing bank; ids of corrected entries are kept."""
    _write(_bucketed(bank, buckets), folder, START, START)


def bank_merger(folder: str, now: Column, ensure: bool = False, *, buckets: int = BUCKETS, most: int = RUNS,
                retain: int = RETAIN) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds batch ``b`` to the bank of a folder.

    Batch ``b`` always starts from the state before it and overwrites its own run, so the last batch may be run again
    after a failure and counts once.  With ``ensure`` only values that are missing are added, and only the buckets
    that the batch touches are read.
    """

    def merge(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if ensure:
            touched = {r[0] for r in _bucketed(uses(rows, now), buckets).select("bucket").distinct().collect()}
            known = [r.path(folder) for k, own in state(_runs(spark, folder), batch).items() if k in touched for r in own]
            fresh = missing_values(_read(spark, folder, known), rows, now)
        else:
            fresh = uses(rows, now)
        _write(_bucketed(fresh, buckets), folder, batch, batch)
        if len(_spans(spark, folder)) <= most:
            return
        due: dict[int, list[Run]] = defaultdict(list)
        runs = _runs(spark, folder)
        earlier = [r for r in runs if r.last < batch or r.first == batch]
        for own in state(earlier, batch + 1).values():
            if chosen := to_merge(own, most):
                due[chosen[-1].first] += chosen
        for first, chosen in due.items():
            _write(_sum(_read(spark, folder, [r.path(folder) for r in chosen]), "bucket"), folder, first, batch)
        _dropped(spark, folder, _runs(spark, folder) if due else runs, batch, retain)

    return merge
