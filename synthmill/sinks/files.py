"""Writers for whole data sets.

Every writer keeps the partitions of the frame: each task writes one part file, and each part is a
complete document of its format.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from synthmill.functions.render import (
    csv_line, record_column, xml_tag, xml_text, yaml_text)
from synthmill.functions.text import is_scalar, scalar_text
from synthmill.operators.reshape import RECORD, entity_split, flatten, per_key, position_column


def _framed(lines: DataFrame, head: str, tail: str, separator: str) -> DataFrame:
    """Lines of each partition between a head and a tail line, with a separator after all but the last.

    Batches pass whole; only the last line of each waits for the next batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(values: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([values], ["value"])
        yield out(pa.array([head]))
        held = pa.array([], pa.string())
        for batch in batches:
            if batch.num_rows:
                known = pa.concat_arrays([held, batch.column(0).cast(pa.string())])
                yield out(pc.binary_join_element_wise(known[:-1], separator, ""))
                held = known[-1:]
        yield out(pa.concat_arrays([held, pa.array([tail])]))

    return lines.mapInArrow(run, "value string")


def write_json(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Each part is one JSON array of records."""
    record, dtype = record_column(df.schema)
    lines = df.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))
    _framed(lines, "[", "]", ",").write.mode(mode).text(path)


def write_ndjson(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, *, delim: str = ".", nested_as_json: bool = False,
              slots: int | None = None, mode: str = "errorifexists") -> None:
    """Flat columns under a header; cells are quoted only where they must be."""
    flat = flatten(df, delim, nested_as_json=nested_as_json, slots=slots, as_text=True)
    flat.write.mode(mode).csv(
        path, header=True, quote='"', escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv_entities(df: DataFrame, row: str, path: str, *, delim: str = ".", as_json: bool = False,
                       mode: str = "errorifexists") -> list[str]:
    """One CSV data set per entity below ``entity=<name>``; returns the entity names."""
    entities = entity_split(df, row, delim, as_json=as_json)
    for name, rows in entities.items():
        write_csv(rows, f"{path}/entity={name}", mode=mode)
    return list(entities)


def entity_blocks(df: DataFrame, row: str, delim: str = ".", as_json: bool = False) -> DataFrame:
    """(block, seq, at, line): the ``# entity:`` sections of one text, ready to be ordered."""
    out = None
    for block, (name, rows) in enumerate(entity_split(df, row, delim, as_json=as_json).items()):
        inside = [] if name == "root" else name.split(delim)
        positions = [c for c in map(position_column, inside) if c in rows.columns]
        fields = [f for f in rows.schema.fields if f.name not in (RECORD, *positions)]
        at = F.array(*[F.col(p).cast("int") for p in positions]) if positions else F.array(F.lit(0))
        data = rows.select(F.lit(block).alias("block"), F.col(RECORD).cast("long").alias("seq"), at.alias("at"),
                           csv_line([scalar_text(F.col(f"`{f.name}`"), f.dataType) for f in fields]).alias("line"))
        heading = csv_line([F.lit(f.name) for f in fields])
        first = df.sparkSession.range(1).select(
            F.lit(block).alias("block"), F.lit(-1).cast("long").alias("seq"), F.array(F.lit(0)).alias("at"),
            F.concat(F.lit(("\n" if block else "") + f"# entity: {name}\n"), heading).alias("line"))
        part = first.unionByName(data)
        out = part if out is None else out.unionByName(part)
    return out


def key_blocks(df: DataFrame, row: str) -> DataFrame:
    """(block, seq, at, line): one section per column, its name and then its values."""
    names = [c for c in flatten(df.select(row, *[c for c in df.columns if c != row]), as_text=True).columns if c != row]
    place = F.array_position(F.lit(names), F.col("key"))
    data = per_key(df, row).select(place.cast("int").alias("block"), F.col(row).alias("seq"), F.array(F.lit(0)).alias("at"),
                                   csv_line([F.col("value")]).alias("line"))
    heads = [(i + 1, -1, [0], ("\n" if i else "") + n) for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(heads, "block int, seq bigint, at array<int>, line string").unionByName(data)


def write_blocks(blocks: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Sections in order; the sort is a range partitioning, so the parts follow one another."""
    ordered = blocks.orderBy("block", "seq", "at").select(F.col("line").alias("value"))
    ordered.write.mode(mode).text(path)


def write_csv_per_key(df: DataFrame, row: str, path: str, *, mode: str = "errorifexists") -> None:
    write_blocks(key_blocks(df, row), path, mode=mode)


def write_xml(df: DataFrame, path: str, *, root_tag: str = "root", record_tag: str = "record", style: str = "indexed",
              self_closing: bool = True, mode: str = "errorifexists") -> None:
    """Records as XML.

    ``indexed`` names the items of an array ``a`` ``a_0``, ``a_1`` …; ``repeated`` repeats the tag, which
    can be read back as an array, and uses Spark's own XML writer.
    """
    root_tag, record_tag = xml_tag(root_tag, "root"), xml_tag(record_tag, "record")
    if style == "repeated":
        named = df.select(*[F.col(f"`{c}`").alias(xml_tag(c)) for c in df.columns])
        named.write.mode(mode).format("xml").options(
            rootTag=root_tag, rowTag=record_tag, attributePrefix="@_", valueTag="#text").save(path)
        return
    record, dtype = record_column(df.schema)
    lines = df.select(F.concat(F.lit("  "), xml_text(record, dtype, record_tag, self_closing, 1)).alias("value"))
    _framed(lines, f"<{root_tag}>", f"</{root_tag}>", "").write.mode(mode).text(path)


def write_yaml(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Records as a stream of YAML documents."""
    record, _ = record_column(df.schema)
    text = F.concat(F.lit("---\n"), F.rtrim(F.regexp_replace(yaml_text(record), r"\n$", "")))
    df.select(text.alias("value")).write.mode(mode).text(path)


def write_txt(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """A frame with one text column as it is, any other as one JSON record a line."""
    if len(df.columns) == 1 and is_scalar(df.schema[0].dataType):
        lines = df.select(scalar_text(F.col(f"`{df.columns[0]}`"), df.schema[0].dataType).alias("value"))
    else:
        record, _ = record_column(df.schema)
        lines = df.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode(mode).text(path)


def convert(df: DataFrame, fmt: str, path: str, **options) -> None:
    """Write any read frame in another format."""
    {"json": write_json, "ndjson": write_ndjson, "csv": write_csv, "xml": write_xml, "yaml": write_yaml,
     "txt": write_txt}[fmt](df, path, **options)
