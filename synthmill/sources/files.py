"""Readers: typed frames from one format, and JSON documents from files of any format."""

from __future__ import annotations

import csv as csvlib
import functools
import io
import itertools
import json
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, types as T, functions as F

from synthmill.functions.batches import batched, rows_of
from synthmill.functions.kinds import trim
from synthmill.functions.lineage import kept
from synthmill.functions.scratch import qualified
from synthmill.sources.splits import has_quotes, larger_than_a_block, quoted_records

# Fixed value: the extensions that count as text.
TEXT_NAME = (r"(?i)\.(json|ya?ml|xml|csv|txt|jsonl|ndjson|md|html?|log|tsv|ini|cfg|conf|properties)$")


# -- typed readers -----------------------------------------------------------------------------
def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON documents; a top-level array gives one row per element."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One record a line; lines that are not JSON are dropped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Header row, all columns text; comment lines are dropped, missing cells are ''.

    Line breaks inside quotes are kept.  Files of one block at most are a task each, as Spark reads them; larger ones are
    read by many tasks (:mod:`synthmill.sources.splits`), or line by line if they hold no quotes at all, which
    ``multi_line=False`` does unasked.
    """
    form = {"comment": "#", "quote": '"', "escape": '"', "ignoreTrailingWhiteSpace": "true", "emptyValue": "", "mode": "PERMISSIVE"}
    large = multi_line and larger_than_a_block(spark, path)
    multi_line = multi_line and (not large or has_quotes(spark, path))
    df = spark.read.options(**form).csv(path, header=True, multiLine=multi_line)
    names = [("field" if re.fullmatch(r"_c[0-9]+", c) else c.strip() or "field") for c in df.columns]
    if large and multi_line:
        records = quoted_records(spark, path)
        folders = records.columns[1:]
        width = len(df.columns) - len(folders)
        # The records come trimmed: the parser fails where it is to trim a blank cell in the first record of a task.
        cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), form | {"ignoreTrailingWhiteSpace": "false"})
        df = records.select(cells.alias("r"), *folders).select("r.*", *folders)
    return df.toDF(*names).na.fill("")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One row per ``row_tag`` element; attributes are ``@_x``, text beside them ``#text``."""
    reader = spark.read.format("xml").options(rowTag=row_tag, attributePrefix="@_", valueTag="#text")
    return (reader.schema(schema) if schema else reader).load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


#: Files and bytes that one task reads, about.
FILES, BYTES = 1 << 14, 128 << 20
_LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
_READ = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's readers leave out."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _inside(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple]:
    """(path, size, is a folder) of what lies in the folders (path, relative to ``folder``)."""
    from pyarrow import fs
    store, base = fs.FileSystem.from_uri(folder)
    for path, in rows_of(batches, "path"):
        for info in store.get_file_info(fs.FileSelector(f"{base}/{path}" if path else base)):
            below = info.type == fs.FileType.Directory
            if not _hidden(info.base_name, below) and (below or info.type == fs.FileType.File):
                yield f"{path}/{info.base_name}" if path else info.base_name, info.size, below


def _contents(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple]:
    from pyarrow import fs
    store, base = fs.FileSystem.from_uri(folder)
    for path, in rows_of(batches, "path"):
        with store.open_input_stream(f"{base}/{path}", compression=None) as file:
            content = file.read()
        yield path, len(content), content


def _opened_by_tasks(folder: str) -> bool:
    """Whether pyarrow opens ``folder``, and it is one."""
    from pyarrow import fs
    try:
        store, base = fs.FileSystem.from_uri(folder)
        return store.get_file_info(base).type == fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return False


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path relative to the folder, size, content) of all files below it, without those that Spark's readers leave out.

    Tasks list the folders, all of one level at once, and the files are dealt out to tasks by their number and size: the
    driver knows neither names nor sizes, and a task opens many files.  What pyarrow cannot open is read by Spark's reader,
    which lists on the driver, makes a task of some 30 small files and leaves out empty ones.
    """
    uri = qualified(spark, folder).rstrip("/")
    if not _opened_by_tasks(uri):
        return _read_by_spark(spark, folder)
    level, found = spark.createDataFrame([("",)], "path string"), []
    while level is not None:
        listed = level.mapInArrow(lambda batches: batched(_inside(batches, uri), _LISTED), "path string, size bigint, folder boolean")
        found.append(kept(listed, "listed"))
        level = found[-1].where("folder").select("path")
        folders = level.count()
        level = level.repartition(min(folders, max(spark.sparkContext.defaultParallelism, -(-folders // FILES)))) if folders else None
    files = functools.reduce(DataFrame.unionByName, found).where("NOT folder")
    number, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-number // FILES), -(-size // BYTES))
    return files.select("path").repartition(min(max(number, 1), tasks)).mapInArrow(
        lambda batches: batched(_contents(batches, uri), _READ), "path string, size bigint, content binary")


def _read_by_spark(spark: SparkSession, folder: str) -> DataFrame:
    base = re.escape(re.sub(r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "", folder).rstrip("/"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), f"^[A-Za-z0-9+.-]+:(//[^/]*)?{base}/", "")
    return files.select(relative.alias("path"), F.col("length").alias("size"), "content")


# -- what a file is ------------------------------------------------------------------------------
def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def sniff_format(path: Column, text: Column) -> Column:
    """json, yaml, xml, csv or txt: by extension, else by how the text starts."""
    name, t = F.lower(base_name(path)), trim(text)
    bracket = F.startswith(t, F.lit("{")) | F.startswith(t, F.lit("["))
    table = F.contains(t, F.lit(",")) & F.contains(t, F.lit("\n"))
    loose = F.when(bracket, "json").when(table, "csv").otherwise("txt")
    return (F.when(name.rlike(r"\.json$"), "json").when(name.rlike(r"\.ya?ml$"), "yaml")
            .when(name.rlike(r"\.xml$"), "xml").when(name.rlike(r"\.csv$"), "csv")
            .when(name.rlike(r"\.(txt|jsonl|ndjson)$"), loose)
            .when(F.startswith(t, F.lit("<")), "xml").when(bracket, "json")
            .when(t.rlike(r"(?m)^[A-Za-z0-9_.-]+:\s") & ~F.contains(t, F.lit(",")), "yaml").otherwise(loose))


def classify_files(files: DataFrame, size: str = "size", max_bytes: int | None = None) -> DataFrame:
    """Add ``reason``: NULL for files to keep, else why a file is left out; sizes count only if ``max_bytes`` is given."""
    reason = F.when(~base_name(F.col("path")).rlike(TEXT_NAME), "not a text file")
    return files.withColumn("reason", reason if max_bytes is None else reason.when(F.col(size) > max_bytes, "too large"))


# -- documents of a mixed corpus -------------------------------------------------------------------
def _csv_records(text: str) -> Iterator[dict]:
    lines = (line for line in csvlib.reader(io.StringIO(text.lstrip("﻿"))) if line and not line[0].startswith("#"))
    first = next(lines, None)
    if first is None:
        return
    header = [h.strip() or "field" for h in first]
    for cells in itertools.chain([next(lines, [""] * len(header))], lines):
        yield {h: (cells[i] if i < len(cells) else "") for i, h in enumerate(header)}


def _xml_value(node):
    out: dict = {f"@_{_local(k)}": v for k, v in node.attrib.items()}
    for child in node:
        key, value = _local(child.tag), _xml_value(child)
        if key in out and isinstance(out[key], list):
            out[key].append(value)
        elif key in out:
            out[key] = [out[key], value]
        else:
            out[key] = value
    text = (node.text or "").strip()
    if not out:
        return _xml_scalar(text)
    return {**out, "#text": _xml_scalar(text)} if text else out


def _xml_scalar(text: str):
    """Plain numbers are read as numbers, padded ones stay text."""
    if re.fullmatch(r"-?(0|[1-9][0-9]{0,14})", text):
        return int(text)
    if re.fullmatch(r"-?(0|[1-9][0-9]{0,14})\.[0-9]+", text):
        return float(text)
    return text


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _parse(fmt: str, text: str) -> Iterator[object]:
    if fmt == "csv":
        yield from _csv_records(text)
    elif fmt == "xml":
        from xml.etree import ElementTree
        node = ElementTree.fromstring(text.strip())
        yield {_local(node.tag): _xml_value(node)}
    else:
        yield from _yaml_records(text)


def _yaml_records(text: str) -> Iterator[object]:
    """The items of a list, composed one at a time, or else the whole document."""
    import yaml
    from yaml.composer import Composer, ComposerError
    from yaml.constructor import SafeConstructor
    from yaml.resolver import Resolver

    if not yaml.__with_libyaml__:
        base = yaml.SafeLoader
    else:
        class base(Composer, yaml.cyaml.CParser, SafeConstructor, Resolver):
            def __init__(self, stream):
                yaml.cyaml.CParser.__init__(self, stream)
                for part in (Composer, SafeConstructor, Resolver):
                    part.__init__(self)

    loader = base(text)
    try:
        loader.get_event()
        if loader.check_event(yaml.StreamEndEvent):
            yield None
            return
        loader.get_event()
        start = loader.peek_event()
        if isinstance(start, yaml.SequenceStartEvent) and start.anchor is None and start.tag in (None, "!", "tag:yaml.org,2002:seq"):
            loader.get_event()
            while not loader.check_event(yaml.SequenceEndEvent):
                yield loader.construct_document(loader.compose_node(None, None))
            loader.get_event()
        else:
            data = loader.construct_document(loader.compose_node(None, None))
            yield from data if isinstance(data, list) else [data]
        loader.get_event()
        if not loader.check_event(yaml.StreamEndEvent):
            raise ComposerError("expected a single document in the stream", start.start_mark, "but found another document",
                                loader.peek_event().start_mark)
    finally:
        loader.dispose()


#: Bytes of the records of a file that are held in memory until the whole file is known to be readable.
HELD = 8 << 20
_DOCUMENTS = pa.schema([("path", pa.string()), ("record", pa.int32()), ("document", pa.string()), ("error", pa.string())])


def _file_records(path: str, fmt: str, text: str) -> Iterator[tuple]:
    with tempfile.SpooledTemporaryFile(HELD) as held:
        try:
            for r in _parse(fmt, text):
                held.write(json.dumps(r, ensure_ascii=False, default=str).encode() + b"\n")
        except (OSError, MemoryError, ImportError):  # the task's failure, not the file's
            raise
        except Exception as e:  # a file that cannot be parsed is reported, not fatal
            yield path, 0, None, type(e).__name__
            return
        held.seek(0)
        for i, line in enumerate(held):
            yield path, i, line[:-1].decode(), None


def _to_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return batched((r for row in rows_of(batches, "path", "format", "content") for r in _file_records(*row)), _DOCUMENTS)


def documents(files: DataFrame) -> DataFrame:
    """(path, record, document, error): the records of text files (path, content) as JSON.

    JSON and line-wise JSON are split inside Spark; CSV, XML and YAML, which need a whole-file
    parser, go through one Arrow-batched step.  No shuffle.
    """
    typed = files.select("path", "content", sniff_format(F.col("path"), F.col("content")).alias("format"))
    text = trim(F.col("content"))
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), trim), lambda s: s != "")
    # A first line that is a document of its own means one document a line; bad lines are skipped.
    by_line = (F.size(lines) > 1) & F.try_parse_json(F.get(lines, F.lit(0))).isNotNull()
    whole = ~by_line & F.try_parse_json(text).isNotNull()
    good = F.filter(lines, lambda s: F.try_parse_json(s).isNotNull())
    inner = F.when(F.col("format") == "txt", F.array(F.to_json(F.struct("content")))).when(whole, F.array(text)).otherwise(good)
    native = typed.where(F.col("format").isin("json", "txt")).select("path", F.posexplode_outer(inner).alias("record", "document"))
    native = native.select("path", F.coalesce("record", F.lit(0)).alias("record"), "document",
                           F.when(F.col("document").isNull(), "no JSON").alias("error"))
    parsed = typed.where(F.col("format").isin("csv", "xml", "yaml")).mapInArrow(
        _to_documents, "path string, record int, document string, error string")
    return native.unionByName(parsed)


def _yaml_rows(path: str, text: str) -> Iterator[tuple]:
    try:
        for r in _yaml_records(text):
            if r is not None and not isinstance(r, dict):
                raise TypeError(f"a record is no mapping but of type {type(r).__name__}")
            yield json.dumps(r, ensure_ascii=False, default=str).encode(),
    except Exception as e:
        raise ValueError(f"unreadable YAML file {path}: {type(e).__name__}: {e}") from e


def read_yaml(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """YAML files as typed rows; a list gives one row per element, null a row of nulls.

    Typed rows have no place for an error, so a file that cannot be read, or holds records that are no mappings, fails the
    job by name instead of being left out.
    """
    docs = read_texts(spark, path).mapInArrow(lambda batches: batched(
        (r for row in rows_of(batches, "path", "content") for r in _yaml_rows(*row)), pa.schema([("document", pa.string())])), "document string")
    return docs.select(F.from_json("document", schema).alias("r")).select("r.*")


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, document) of text files: JSON, comma-separated or one ``content`` each."""
    texts = read_texts(spark, path)
    return documents(texts).where("error IS NULL").drop("error")
