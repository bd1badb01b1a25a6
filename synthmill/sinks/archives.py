"""Pack entries into zip, tar and tar.gz archives."""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from synthmill.functions import draws as d
from synthmill.functions.batches import batched, rows_of
from synthmill.functions.lineage import dealt, kept
from synthmill.functions.naming import EXTENSIONS, clean_segment
from synthmill.functions.render import csv_line, json_text, record_column, xml_tag, xml_text, yaml_text
from synthmill.functions.scratch import qualified
from synthmill.functions.text import scalar_text
from synthmill.operators.reshape import flatten, split_n

FORMATS = ("zip", "tar", "tar.gz")

# An archive is one file and is written by one task, whatever its size.  Numbered volumes are made only where the caller
# names their size: then each is written by a task of its own.

# -- packing in memory, for small archives ------------------------------------------------------
def pack(entries: Iterable[tuple[str, bytes]], fmt: str) -> bytes:
    """Archive bytes; the same entries always give the same bytes."""
    out = io.BytesIO()
    writer = _Writer(out, fmt)
    for name, data in entries:
        writer.begin(name, len(data))
        writer.write(data)
    writer.close()
    return out.getvalue()


#: A header without name, size and checksum (blanks, as it is summed).
_BLANK = bytearray(tarfile.TarInfo("").tobuf(tarfile.PAX_FORMAT))
_BLANK[124:136], _BLANK[148:156] = bytes(12), b" " * 8
_BLANK_SUM = sum(_BLANK)


def tar_header(name: str, size: int) -> bytes:
    """What ``TarInfo`` writes for a plain file; short ASCII names, which need no extended header, are put in a ready one."""
    if len(name) > 100 or not name.isascii() or size >= 8 ** 11:
        info = tarfile.TarInfo(name)
        info.size = size
        return info.tobuf(tarfile.PAX_FORMAT)
    path, length = name.encode("ascii"), b"%011o\0" % size
    out = bytearray(_BLANK)
    out[:len(path)], out[124:136] = path, length
    out[148:156] = b"%06o\0 " % (_BLANK_SUM + sum(path) + sum(length))
    return bytes(out)


class _Writer:
    """Streams entries into an archive; an entry may arrive in pieces of a known total size."""

    def __init__(self, out, fmt: str, level: int = 9):
        self.fmt, self.entry = fmt, None
        if fmt == "zip":
            self.archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
            return
        self.gz = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=level, mtime=0) if fmt == "tar.gz" else None
        self.sink = self.gz or out
        self.left = 0

    def begin(self, name: str, size: int) -> None:
        self._end()
        if self.fmt == "zip":
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            self.entry = self.archive.open(info, "w", force_zip64=size >= 1 << 31)
            return
        self.sink.write(tar_header(name, size))
        self.left, self.entry = size, -size % tarfile.BLOCKSIZE

    def write(self, data: bytes) -> None:
        if self.fmt == "zip":
            self.entry.write(data)
        else:
            self.sink.write(data)
            self.left -= len(data)

    def _end(self) -> None:
        if self.entry is None:
            return
        if self.fmt == "zip":
            self.entry.close()
        else:
            if self.left:
                raise ValueError("entry does not have its announced size")
            self.sink.write(b"\0" * self.entry)
        self.entry = None

    def close(self) -> None:
        self._end()
        if self.fmt == "zip":
            self.archive.close()
            return
        self.sink.write(b"\0" * (2 * tarfile.BLOCKSIZE))
        if self.gz:
            self.gz.close()


#: Characters of pieces that are written at once, and the gzip level, that of the gzip tool: one task compresses an archive.
JOINED, LEVEL = 1 << 16, 6

# -- packing at scale -----------------------------------------------------------------------------
def volume_name(archive: Column, volume: Column) -> Column:
    """``pack.zip``, ``pack_2.zip``, ``pack_3.zip`` …"""
    ext = F.regexp_extract(archive, r"(?i)(\.tar\.gz|\.tgz|\.[^./]*)$", 1)
    stem = F.left(archive, F.length(archive) - F.length(ext))
    return F.when(volume == 0, archive).otherwise(F.concat(stem, F.lit("_"), (volume + 1).cast("string"), ext))


def write_archives(pieces: DataFrame, folder: str, fmt: str, volume_entries: int | None = None) -> DataFrame:
    """Write archives from (archive, entry_no, entry, seq, text) rows; gives (archive, entries, bytes).

    One task writes an archive, but as a stream: pieces arrive sorted and only one is in memory.  The
    size of each entry is summed beforehand.  A finished archive replaces the target in one move, so a
    retried task leaves no half-written file.  ``entry_no`` counts the entries of an archive from 0.  With
    ``volume_entries``, an archive of more entries becomes numbered volumes.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown archive format {fmt!r}")
    if volume_entries is not None:
        pieces = pieces.withColumn("archive", volume_name(F.col("archive"), d.div(F.col("entry_no").cast("long"), volume_entries)))
    pieces = kept(pieces, "pieces")  # rendered once, read twice
    sizes = pieces.groupBy("archive", "entry_no").agg(F.sum(F.octet_length("text")).alias("size"))
    target_folder = qualified(pieces.sparkSession, folder)
    rows = pieces.join(sizes, ["archive", "entry_no"]).repartition("archive").sortWithinPartitions("archive", "entry_no", "seq")

    def rows_written(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
        import uuid
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(target_folder)
        store.create_dir(base, recursive=True)
        current = opened = writer = last = None
        count = waiting = 0
        pieces: list[str] = []

        def flush():
            writer.write("".join(pieces).encode("utf-8"))
            pieces.clear()

        def finish():
            flush()
            writer.close()
            size = stream.tell()
            stream.close()
            target = posixpath.join(base, current)
            store.move(opened, target)
            return current, count, size

        for archive, no, entry, text, size in rows_of(batches, "archive", "entry_no", "entry", "text", "size"):
            if archive != current:
                if writer is not None:
                    yield finish()
                current, last, count = archive, None, 0
                opened = posixpath.join(base, f".{archive}.{uuid.uuid4().hex}")
                stream = store.open_output_stream(opened, compression=None)
                writer = _Writer(stream, fmt, LEVEL)
            if no != last:
                if pieces:
                    flush()
                writer.begin(entry, int(size))
                last, count, waiting = no, count + 1, 0
            pieces.append(text)
            waiting += len(text)
            if waiting > JOINED:
                flush()
                waiting = 0
        if writer is not None:
            yield finish()

    done = pa.schema([("archive", pa.string()), ("entries", pa.int32()), ("bytes", pa.int64())])
    return rows.select("archive", "entry_no", "entry", "seq", "text", "size").mapInArrow(
        lambda batches: batched(rows_written(batches), done), "archive string, entries int, bytes bigint")


def entry_name(name: str, fmt: str, top_folder: str | None = None) -> str:
    """Safe entry path with an extension that fits the format, below an optional folder."""
    ext = EXTENSIONS.get(fmt, fmt)
    base = clean_segment(name)
    known = (".json", ".xml", ".csv", ".txt", ".yml", ".yaml")
    base = base if base.lower().endswith(known) else f"{base}.{ext}"
    return f"{clean_segment(top_folder)}/{base}" if (top_folder or "").strip() else base


def document_pieces(df: DataFrame, index: str, fmt: str, last: Column, alone: Column, keys: Sequence[str] = (), *,
                    root_tag: str = "root", record_tag: str = "record") -> DataFrame:
    """(keys…, seq, text): a whole document record by record.

    ``index`` counts from 0 within the document, ``last`` marks its last record and ``alone`` a document
    of one record, which is written as an object instead of a list.
    """
    record, dtype = record_column(df.schema, (index, *keys, "__last", "__alone"))
    first = F.col(index) == 0
    marked = df.withColumns({"__last": last, "__alone": alone})
    last, alone = F.col("__last"), F.col("__alone")
    if fmt in ("json", "txt"):
        text = F.when(alone, json_text(record, dtype)).otherwise(F.concat(
            F.when(first, "[\n").otherwise(""), F.lit("  "), json_text(record, dtype, 2, 1), F.when(last, "\n]").otherwise(",\n")))
    elif fmt == "xml":
        root = xml_tag(root_tag, "root")
        text = F.when(alone, xml_text(record, dtype, root)).otherwise(F.concat(
            F.when(first, f"<{root}>\n").otherwise(""), F.lit("  "), xml_text(record, dtype, xml_tag(record_tag, "record"), True, 1),
            F.when(last, f"\n</{root}>").otherwise("\n")))
    elif fmt == "yaml":
        body = yaml_text(record)
        text = F.when(alone, body).otherwise(F.concat(F.lit("- "), F.regexp_replace(body, r"\n(?=.)", "\n  ")))
    elif fmt == "csv":
        kept = (index, *keys, "__last", "__alone")
        marked = flatten(marked.select(*kept, *dtype.names))
        fields = [f for f in marked.schema.fields if f.name not in kept]
        line = csv_line([scalar_text(F.col(f"`{f.name}`"), f.dataType) for f in fields])
        head = csv_line([F.lit(f.name) for f in fields])
        text = F.concat(F.when(first, F.concat(head, F.lit("\n"))).otherwise(""), line, F.when(last, "").otherwise("\n"))
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return marked.select(*keys, F.col(index).cast("long").alias("seq"), text.alias("text"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _volumes(df: DataFrame, index: str, archive: str, size: Column, limit: int | None) -> tuple[DataFrame, Column, Column]:
    """(frame with ``archive`` and the index within its volume, is last, is alone) of one document; without a limit it is one volume."""
    if limit is None:
        out = df.withColumns({"archive": F.lit(archive), "__held": size, index: F.col(index).cast("long")})
        return out, F.col(index) == F.col("__held") - 1, F.col("__held") == 1
    volume = d.div(F.col(index).cast("long"), limit)
    start = volume * d.long(limit)
    held = F.least(size - start, d.long(limit))
    out = df.withColumns({"archive": volume_name(F.lit(archive), volume), "__held": held,
                          index: F.col(index).cast("long") - start})
    return out, F.col(index) == F.col("__held") - 1, F.col("__held") == 1


def multi_format_pieces(df: DataFrame, index: str, files: Sequence[tuple[str, str]], archive: str,
                        top_folder: str | None = None, total: int | None = None,
                        volume_records: int | None = None) -> DataFrame:
    """The same records as several documents of one archive; ``index`` is dense and starts at 0."""
    total = df.count() if total is None else total
    rows, last, alone = _volumes(dealt(df, total, index), index, archive, d.long(total), volume_records)
    return _union([document_pieces(rows, index, fmt, last, alone, ("archive", "__held")).select(
        "archive", F.lit(no).alias("entry_no"), F.lit(entry_name(name, fmt, top_folder)).alias("entry"), "seq", "text")
        for no, (name, fmt) in enumerate(files)])


def split_pieces(df: DataFrame, index: str, files: Sequence[tuple[str, str]], archive: str,
                 top_folder: str | None = None, total: int | None = None,
                 volume_records: int | None = None) -> DataFrame:
    """Contiguous batches of the records, one document each; empty batches give an empty list."""
    total = df.count() if total is None else total
    n = len(files)
    size = max(-(-total // n), 1)
    batched = split_n(df, index, n, total).withColumn(index, F.col(index) % size)
    parts = []
    for no, (name, fmt) in enumerate(files):
        held = max(0, min(size, total - no * size))
        entry = F.lit(entry_name(name, fmt, top_folder))
        if held == 0:
            # What an empty list looks like in each format.
            text = {"xml": "<root/>", "csv": "", "yaml": "[]\n"}.get(fmt, "[]")
            rows = df.sparkSession.range(1).select(F.lit(archive).alias("archive"), F.lit(0).cast("long").alias("seq"), F.lit(text).alias("text"))
        else:
            mine = dealt(batched.where(F.col("batch") == no).drop("batch"), held, index)
            mine, last, alone = _volumes(mine, index, archive, d.long(held), volume_records)
            rows = document_pieces(mine, index, fmt, last, alone, ("archive", "__held"))
        parts.append(rows.select("archive", F.lit(no).alias("entry_no"), entry.alias("entry"), "seq", "text"))
    return _union(parts)
