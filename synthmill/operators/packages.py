"""Packages: many files that together are one record."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from synthmill.functions.batches import batched, rows_of
from synthmill.functions.lineage import kept
from synthmill.functions.render import render
from synthmill.operators import infer as I
from synthmill.operators.generate import SchemaPlan
from synthmill.schema import Schema
from synthmill.session import tune
from synthmill.sinks.archives import pack
from synthmill.sinks.records import write_files
from synthmill.sources.archives import expand_archives, folder_of
from synthmill.sources.files import documents, sniff_format

_SEP = "\x1f"


@dataclass(frozen=True)
class Imported:
    """Frames of an import, all keyed by package."""

    members: DataFrame   # package, path, name, kind, format, content, archive_path, archive_format
    schemas: DataFrame   # package, member, and the columns of a schema table
    values: DataFrame    # package, member, path, value: harvested for the bank
    skipped: DataFrame   # package, path, reason


def import_entries(entries: DataFrame, depth: int | None = None) -> Imported:
    """Members, schemas and values from expanded entries (see ``expand_archives``)."""
    text = F.decode("content", "UTF-8")
    members = entries.where("kind <> 'skipped'").select(
        F.col("path").alias("package"), F.col("entry").alias("path"), F.substring_index("entry", "/", -1).alias("name"),
        F.when(F.col("kind") == "nested", "nested_archive_folder").otherwise("text").alias("kind"),
        F.when(F.col("kind") == "file", sniff_format(F.col("entry"), text)).alias("format"),
        F.when(F.col("kind") == "file", text).alias("content"), "archive_path", "archive_format")
    files = members.where("kind = 'text'").select(F.concat_ws(_SEP, "package", "path").alias("path"), "content")
    docs = documents(files)
    # Written once: the depth, the schemas, the values and the errors all read the documents.
    keyed = kept(docs.select(F.substring_index("path", _SEP, 1).alias("package"), F.substring_index("path", _SEP, -1).alias("member"),
                             "record", "document", "error"), "documents")
    by = ["package", "member"]
    rows = I.document_leaves(keyed.where("document IS NOT NULL"), "document", "record", by, depth)
    failed = keyed.where("error IS NOT NULL").select("package", F.col("member").alias("path"), F.col("error").alias("reason"))
    left_out = entries.where("kind = 'skipped'").select(F.col("path").alias("package"), F.col("entry").alias("path"), "reason")
    values = I.harvest_values(rows, by).select(*by, "path", "value")
    return Imported(members, I.schema_rows(rows, by), values, left_out.unionByName(failed.distinct()))


def import_packages(files: DataFrame, depth: int | None = None, package: str | None = None) -> Imported:
    """Import archives (path, content), one package each, or with ``package`` the files of one folder.

    The expanded entries are kept once in the checkpoint folder, because every frame of the result
    reads them; archives are not opened again for each.
    """
    return import_entries(kept(expand_archives(files, package), "entries"), depth)


def nested_map(members: DataFrame) -> DataFrame:
    """(package, folder_path, archive_path, archive_format) of the inner archives."""
    return members.where("kind = 'nested_archive_folder'").select(
        "package", folder_of(F.col("archive_path")).alias("folder_path"), "archive_path", "archive_format")


def hydrate(members: DataFrame, schemas: DataFrame) -> DataFrame:
    """Members with their schema as an ordered array; a schema is no larger than its file."""
    row = F.struct("path", "sort_order", "name", "parent", "kind", "sample", "is_primary", "is_unique")
    trees = schemas.groupBy("package", F.col("member").alias("path")).agg(F.sort_array(F.collect_list(row)).alias("schema_rows"))
    # Both sides grow with the import, but sizes estimated from small compressed files make one look fit for a broadcast.
    return members.join(trees.hint("merge"), ["package", "path"], "left")


def member_leaves(schemas: DataFrame) -> DataFrame:
    """(package, member, path) of every leaf, for choosing field modes."""
    return schemas.where(F.col("kind") == I.VALUE).select("package", "member", "path")


@dataclass(frozen=True)
class Member:
    """One text file of a package that is to be varied."""

    path: str
    schema: Schema
    fmt: str


def variant_rows(spark: SparkSession, members: Sequence[Member], n: int, seed: int, *,
                 modes: Mapping[str, Mapping[str, str]] | None = None, default: str = "random",
                 bank: Mapping[str, Sequence[str]] | None = None, rows: DataFrame | None = None,
                 row_id: str = "id") -> DataFrame:
    """(variant, files): ``n`` full copies of the package with newly generated contents, one a row.

    All files of a variant are made in the same row, so neither generating nor packing shuffles.
    Variants count from 1.  Unique fields do not repeat over all variants.  ``rows`` may give the row
    ids (0-based) instead of a range.
    """
    tune(spark)
    base = spark.range(n).select(F.col("id").alias("__id")) if rows is None else rows.select(F.col(row_id).alias("__id"))
    modes = modes or {}
    records, types = [F.col("__id")], []
    for i, m in enumerate(members):
        schema = m.schema.with_modes(modes.get(m.path) or modes.get(m.path.lower()), default)
        columns = SchemaPlan(schema, seed, bank, scope=m.path).columns(F.col("__id"))
        records.append(F.struct(*columns).alias(f"m{i}"))
        types.append(m)
    made = base.select(*records)
    files = [F.struct(F.lit(m.path).alias("path"), render(F.col(f"m{i}"), made.schema[f"m{i}"].dataType, m.fmt).alias("content"))
             for i, m in enumerate(types)]
    return made.select((F.col("__id") + 1).alias("variant"), F.array(*files).alias("files"))


def variants(spark: SparkSession, members: Sequence[Member], n: int, seed: int, **options) -> DataFrame:
    """(variant, path, content) of the generated packages; options as for ``variant_rows``."""
    return variant_rows(spark, members, n, seed, **options).select("variant", F.inline("files"))


@dataclass(frozen=True)
class NestedArchive:
    folder: str
    archive_path: str
    fmt: str


def _bottom_up(files: dict[str, bytes], nested: Sequence[NestedArchive]) -> dict[str, bytes]:
    """Replace every folder that stands for an inner archive by the archive, deepest first."""
    for inner in sorted(nested, key=lambda x: -x.folder.count("/")):
        below = f"{inner.folder}/"
        held = {p: c for p, c in files.items() if p.startswith(below)}
        files = {p: c for p, c in files.items() if not p.startswith(below) and p != inner.folder}
        files[inner.archive_path] = pack([(p[len(below):], c) for p, c in sorted(held.items())], inner.fmt)
    return files


def repack(made: DataFrame, name: str, outer: str = "zip", nested: Sequence[NestedArchive] = (),
           extension: str | None = None) -> DataFrame:
    """(path, content) of the packed ``variant_rows``: ``name_0001.zip`` …, or files below ``name_0001/``."""
    number = F.col("variant").cast("string")
    label = F.concat(F.lit(f"{name}_"), F.lpad(number, F.greatest(F.length(number), F.lit(4)), "0"))
    if outer == "folder" and not nested:
        return made.select(label.alias("label"), F.inline("files")).select(
            F.concat_ws("/", "label", "path").alias("path"), F.encode("content", "UTF-8").alias("content"))
    ext = "" if outer == "folder" else extension or f".{outer}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for top, files in rows_of(batches, "label", "files"):
            packed = _bottom_up({f["path"]: f["content"].encode("utf-8") for f in files}, nested)
            if outer == "folder":
                yield from ((posixpath.join(top, p), c) for p, c in sorted(packed.items()))
            else:
                yield f"{top}{ext}", pack(sorted(packed.items()), outer)

    form = pa.schema([("path", pa.string()), ("content", pa.binary())])
    return made.select(label.alias("label"), "files").mapInArrow(lambda batches: batched(rows(batches), form), "path string, content binary")


def write_variants(made: DataFrame, folder: str, name: str, outer: str = "zip",
                   nested: Sequence[NestedArchive] = (), extension: str | None = None) -> DataFrame:
    """Write the packed variants; gives (path, status, bytes)."""
    return write_files(repack(made, name, outer, nested, extension), folder)
