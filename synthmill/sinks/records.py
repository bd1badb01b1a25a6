"""One file per record, written by the tasks that hold the records."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from synthmill.functions.lineage import dealt, kept
from synthmill.functions.naming import NameContext, Naming
from synthmill.functions.render import record_column, render
from synthmill.functions.scratch import qualified
from synthmill.operators.naming import name_records


STAGED = "path string, staged string, bytes bigint"


def _stage(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    """Write contents to files that only this attempt of the task knows."""
    from pyarrow import fs
    store, base = fs.FileSystem.from_uri(folder)
    own = posixpath.join(base, uuid.uuid4().hex)
    store.create_dir(own, recursive=True)
    made = 0
    for batch in batches:
        done = []
        for path, content in zip(batch["path"], batch["content"]):
            data = content if isinstance(content, bytes) else content.encode("utf-8")
            staged = f"{own}/{made}"
            made += 1
            with store.open_output_stream(staged, compression=None) as out:
                out.write(data)
            done.append((path, staged, len(data)))
        yield pd.DataFrame(done, columns=["path", "staged", "bytes"])


def _place(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    """Move staged files to their places; one that an earlier attempt moved is there already."""
    from pyarrow import fs
    store, base = fs.FileSystem.from_uri(folder)
    made: set[str] = set()
    for batch in batches:
        for path, staged in zip(batch["path"], batch["staged"]):
            target = posixpath.join(base, path)
            parent = posixpath.dirname(target)
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            try:  # most stores replace what is there
                store.move(staged, target)
                continue
            except OSError:
                pass
            waiting, there = (i.type == fs.FileType.File for i in store.get_file_info([staged, target]))
            if waiting and there:
                store.delete_file(target)
            if waiting:
                store.move(staged, target)
            elif not there:
                raise FileNotFoundError(f"{path}: neither staged nor in its place")
        yield pd.DataFrame({"path": batch["path"], "status": "written", "bytes": batch["bytes"]})


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write (path, content) rows below a folder; gives (path, status, bytes).

    ``folder`` is any location pyarrow can open and all executors share; without a file system it is in the default one
    of the cluster.  Tasks write to a staging folder below it, and the files of those attempts that Spark commits are
    moved to their places by a second job.  So a lost executor or a second attempt leaves neither half a file nor one
    too many; if the first job fails, nothing is written, and if the second does, only whole files are.  The files are there when this returns; the result is a table.
    """
    spark = rows.sparkSession
    target = qualified(spark, folder)
    staging = f"{target.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    try:
        staged = kept(rows.select("path", "content").mapInPandas(partial(_stage, folder=staging), STAGED), "staged")
        placed = staged.mapInPandas(partial(_place, folder=target), "path string, status string, bytes bigint")
        return kept(placed, "placed")
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(staging)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def record_files(df: DataFrame, row: str, naming: Naming, ctx: NameContext, *, existing: DataFrame | None = None,
                 keep_row: bool = False, **format_options) -> DataFrame:
    """(row, path, content) of every record, names resolved, content in the format of the context."""
    named = dealt(name_records(df, row, naming, ctx, "__path", existing), df.count(), row)
    record, dtype = record_column(named.schema, ("__path",) if keep_row else ("__path", row))
    return named.select(F.col(row), F.col("__path").alias("path"), render(record, dtype, ctx.fmt, **format_options).alias("content"))


def write_per_record(df: DataFrame, row: str, folder: str, naming: Naming, ctx: NameContext, *,
                     existing: DataFrame | None = None, **format_options) -> DataFrame:
    """One file per record; records the ``skip`` policy leaves out do not appear in the result."""
    return write_files(record_files(df, row, naming, ctx, existing=existing, **format_options), folder)
