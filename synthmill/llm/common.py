"""Small helpers of the text operators: batches of texts, blocks, shared scratch folders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from synthmill.functions.scratch import scratch
from synthmill.session import small_batches

#: Bytes of text a Python step handles at once.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrowed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key (long) and the text, under fixed names, whatever else the frame holds."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def as_bytes(texts: Iterable[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in texts]


def rows_of(batch: pa.RecordBatch, rows: int = 256) -> Iterator[tuple]:
    """The rows of a batch; only some at a time become Python values."""
    for start in range(0, batch.num_rows, rows):
        yield from zip(*(c.to_pylist() for c in batch.slice(start, rows).columns), strict=True)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of a batch of (doc_id, text), in runs of about ``limit`` characters; a longer text is a run of its own."""
    ids: list = []
    texts: list[str | None] = []
    size = 0
    for key, text in rows_of(batch):
        n = len(text or "") + 64
        if size and size + n > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(key)
        texts.append(text)
        size += n
    if texts:
        yield ids, texts


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the session's shared folder, read again: lineage ends there and every use reads one result."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
