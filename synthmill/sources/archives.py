"""Zip, tar and tar.gz archives as rows."""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from synthmill.functions.batches import batched, rows_of
from synthmill.sources.files import TEXT_NAME

#: Archives within archives that are opened unless the caller says otherwise: a guard against archives that hold themselves.
NEST_DEPTH = 64

ENTRY_SCHEMA = ("path string, kind string, entry string, size bigint, is_directory boolean, content binary, "
                "archive_path string, archive_format string, reason string")


def archive_format(name: str) -> str | None:
    low = name.lower()
    if low.endswith((".tar.gz", ".tgz")):
        return "tar.gz"
    return "tar" if low.endswith(".tar") else "zip" if low.endswith(".zip") else None


def archive_format_column(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike(r"\.(tar\.gz|tgz)$"), "tar.gz").when(low.rlike(r"\.tar$"), "tar").when(low.rlike(r"\.zip$"), "zip")


def folder_of(archive_path: Column) -> Column:
    """Folder an archive unfolds to: its path without the archive extension."""
    cut = F.regexp_replace(archive_path, r"(?i)(\.tar\.gz|\.tgz|\.zip|\.tar)$", "")
    leaf = F.substring_index(cut, "/", -1)
    return F.when(leaf == "", F.concat(cut, F.lit("archive"))).otherwise(cut)


def clean_entry(path: str) -> str:
    """Posix path without empty, ``.`` and ``..`` segments."""
    parts = (p.strip() for p in path.replace("\\", "/").split("/"))
    return "/".join(p for p in parts if p and p not in (".", ".."))


#: Bytes up to which an entry of a tar is read in one call of the archive's own (buffered) file.
AT_ONCE = 8192


class _Header(tarfile.TarInfo):
    """Headers of plain files with short names are read by their name, size and checksum; all others as ``tarfile`` does."""

    @classmethod
    def frombuf(cls, buf, encoding, errors):
        size, told = buf[124:136].split(b"\0", 1)[0], buf[148:156].split(b"\0", 1)[0].strip()
        plain = len(buf) == tarfile.BLOCKSIZE and buf[156:157] == tarfile.REGTYPE and not buf[345] and size.isdigit() and told.isdigit()
        if not plain or b"8" in size + told or b"9" in size + told or sum(buf) - sum(buf[148:156]) + 256 != int(told, 8):
            return super().frombuf(buf, encoding, errors)
        out = cls(buf[:100].split(b"\0", 1)[0].decode(encoding, errors))
        out.size = int(size, 8)
        return out


def _tar_reader(t: tarfile.TarFile, info: tarfile.TarInfo) -> Callable[[], bytes]:
    def read() -> bytes:
        if info.size > AT_ONCE or info.sparse is not None:
            return t.extractfile(info).read()
        t.fileobj.seek(info.offset_data)
        data = t.fileobj.read(info.size)
        if len(data) < info.size:
            raise tarfile.ReadError("unexpected end of data")
        return data
    return read


def iter_entries(data: bytes, fmt: str) -> Iterator[tuple[str, int, bool, Callable[[], bytes]]]:
    """(path, size, is directory, reader) of each entry; an entry is only unpacked when its reader is called."""
    if fmt == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                name = clean_entry(info.filename)
                if name:
                    yield name, info.file_size, info.is_dir(), lambda: z.read(info)
        return
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz" if fmt == "tar.gz" else "r:", tarinfo=_Header) as t:
        for info in t:
            t.members = []  # else it keeps every header read
            name = clean_entry(info.name)
            if name and (info.isdir() or info.isfile()):
                yield name, info.size, info.isdir(), _tar_reader(t, info)


def _strip(name: str) -> str:
    return re.sub(r"(?i)(\.tar\.gz|\.tgz|\.zip|\.tar)$", "", name) or "archive"


def _expand(source: str, entry: str, data: bytes, deeper: int, max_bytes: int | None) -> Iterator[tuple]:
    name = posixpath.basename(entry)
    fmt = archive_format(name)
    if fmt is None:
        reason = None if re.search(TEXT_NAME, name) else "not a text file"
        reason = reason or ("too large" if max_bytes is not None and len(data) > max_bytes else None)
        yield (source, "skipped" if reason else "file", entry, len(data), False, None if reason else data, None, None, reason)
        return
    if deeper < 0:
        yield (source, "skipped", entry, len(data), False, None, None, None, "nested too deep")
        return
    folder = posixpath.join(posixpath.dirname(entry), _strip(name))
    yield (source, "nested", folder, len(data), True, None, entry, fmt, None)
    try:
        for inner, _, is_dir, read in iter_entries(data, fmt):
            if not is_dir:
                yield from _expand(source, f"{folder}/{inner}", read(), deeper - 1, max_bytes)
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, RuntimeError) as e:
        yield (source, "skipped", entry, len(data), False, None, None, None, f"unreadable archive: {type(e).__name__}")


_ENTRIES = pa.schema([("path", pa.string()), ("kind", pa.string()), ("entry", pa.string()), ("size", pa.int64()), ("is_directory", pa.bool_()),
                      ("content", pa.binary()), ("archive_path", pa.string()), ("archive_format", pa.string()), ("reason", pa.string())])
_LISTED = pa.schema([("path", pa.string()), ("at", pa.int32()), ("entry", pa.string()), ("size", pa.int64()), ("is_directory", pa.bool_()),
                     ("content", pa.binary())])


def expand_archives(files: DataFrame, package: str | None = None, *, max_depth: int = NEST_DEPTH,
                    max_bytes: int | None = None) -> DataFrame:
    """Entries of archive files (path, content), nested archives opened in place.

    ``kind`` is ``file``, ``nested`` (the folder that stands for an inner archive) or ``skipped`` (with a
    reason).  Each archive is read by the task that holds it; nothing is shuffled.  With ``package`` the
    files are the contents of one folder of that name, and archives among them count as inner ones.
    Archives nested deeper than ``max_depth``, and texts above ``max_bytes`` if given, are skipped with that reason.
    """

    def rows(batches):
        for path, content in rows_of(batches, "path", "content"):
            fmt = archive_format(path)
            if package is not None:
                yield from _expand(package, clean_entry(path), content, max_depth, max_bytes)
                continue
            if fmt is None:
                yield from _expand(path, posixpath.basename(path), content, max_depth, max_bytes)
                continue
            try:
                for entry, _, is_dir, read in iter_entries(content, fmt):
                    if not is_dir:
                        yield from _expand(path, entry, read(), max_depth, max_bytes)
            except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, RuntimeError) as e:
                yield (path, "skipped", posixpath.basename(path), len(content), False, None, None, None,
                       f"unreadable archive: {type(e).__name__}")

    return files.select("path", "content").mapInArrow(lambda batches: batched(rows(batches), _ENTRIES), ENTRY_SCHEMA)


def _listing(files: DataFrame, wanted: str | None = None) -> DataFrame:
    """Entries of archives; the content only of files whose path equals ``wanted`` without case."""

    def rows(batches):
        for path, content in rows_of(batches, "path", "content"):
            fmt = archive_format(path)
            for i, (e, s, d, read) in enumerate(iter_entries(content, fmt) if fmt else ()):
                if wanted is None or (not d and e.lower() == wanted):
                    yield path, i, e, s, d, None if wanted is None else read()

    return files.select("path", "content").mapInArrow(
        lambda batches: batched(rows(batches), _LISTED), "path string, at int, entry string, size bigint, is_directory boolean, content binary")


def list_archive(files: DataFrame) -> DataFrame:
    """(path, entry, size, is_directory); the first of entries that differ only in case is kept."""
    first = F.min_by(F.struct("entry", "size"), F.col("at"))
    rows = _listing(files).groupBy("path", "is_directory", F.lower("entry").alias("key")).agg(first.alias("first"))
    return rows.select("path", "first.entry", "first.size", "is_directory")


def read_entry(files: DataFrame, entry: str, max_bytes: int | None = None) -> DataFrame:
    """One entry of each archive by case-insensitive path, as text (up to ``max_bytes``, if given); binary ones only flagged."""
    rows = _listing(files, clean_entry(entry).lower())
    head = F.col("content") if max_bytes is None else F.substring(F.col("content"), 1, max_bytes)
    cut = F.lit(False) if max_bytes is None else F.col("size") > max_bytes
    binary = F.contains(F.substring(F.col("content"), 1, 8000), F.lit(b"\x00"))
    texty = F.col("entry").rlike(TEXT_NAME)
    binary = binary | (~texty & (F.col("size") > 64 * 1024))
    return rows.select("path", "entry", "size", binary.alias("binary"),
                       (~binary & cut).alias("truncated"),
                       F.when(~binary, F.decode(head, "UTF-8")).alias("content"))
