"""Records as text: every renderer is a column over a typed record."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, types as T, functions as F

from synthmill.functions.text import is_scalar, scalar_text


def record_column(schema: T.StructType, skip: tuple[str, ...] = ()) -> tuple[Column, T.StructType]:
    """All columns of a frame but ``skip`` as one struct, with its type."""
    fields = [f for f in schema.fields if f.name not in skip]
    return F.struct(*[F.col(f"`{f.name}`").alias(f.name) for f in fields]), T.StructType(fields)


# -- JSON -----------------------------------------------------------------------------------
def _json_scalar(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.BooleanType, T.NumericType)):
        text = scalar_text(c, dtype)
    else:
        quoted = F.to_json(F.array(scalar_text(c, dtype)))
        text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return F.coalesce(text, F.lit("null"))


def json_text(c: Column, dtype: T.DataType, indent: int = 2, depth: int = 0) -> Column:
    """JSON with line breaks and the given indent; absent values are ``null``."""
    if is_scalar(dtype):
        return F.when(c.isNull(), F.lit("null")).otherwise(_json_scalar(c, dtype))
    outer, inner = "\n" + " " * indent * depth, "\n" + " " * indent * (depth + 1)
    if isinstance(dtype, T.StructType):
        if not dtype.fields:
            return F.lit("{}")
        parts = []
        for i, f in enumerate(dtype.fields):
            parts.append(F.lit(("," if i else "{") + inner + json.dumps(f.name, ensure_ascii=False) + ": "))
            parts.append(json_text(c.getField(f.name), f.dataType, indent, depth + 1))
        return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(*parts, F.lit(outer + "}")))
    items = F.transform(c, lambda x: json_text(x, dtype.elementType, indent, depth + 1))
    return F.when(c.isNull(), F.lit("null")).when(F.size(c) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("[" + inner), F.array_join(items, "," + inner), F.lit(outer + "]")))


# -- XML ------------------------------------------------------------------------------------
def xml_tag(name: str, fallback: str = "item") -> str:
    """A legal element name: other characters become ``_``."""
    safe = re.sub(r"[^A-Za-z0-9_.-]", "_", (name or "").strip() or fallback)
    return safe if re.match(r"[A-Za-z_]", safe) else f"_{safe}"


def _xml_escape(c: Column) -> Column:
    # The characters XML text must not contain as such.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def _element(tag: Column, inner: Column, self_closing: bool) -> Column:
    empty = F.concat(F.lit("<"), tag, F.lit("/>")) if self_closing else F.concat(F.lit("<"), tag, F.lit("></"), tag, F.lit(">"))
    return F.when(F.coalesce(inner, F.lit("")) == "", empty).otherwise(
        F.concat(F.lit("<"), tag, F.lit(">"), inner, F.lit("</"), tag, F.lit(">")))


def xml_text(c: Column, dtype: T.DataType, tag: Column | str, self_closing: bool = True, depth: int = 0) -> Column:
    """One element: objects nest by key, the items of an array ``a`` are called ``a_0``, ``a_1`` …"""
    tag = F.lit(xml_tag(tag)) if isinstance(tag, str) else tag
    outer, inner = "\n" + "  " * depth, "\n" + "  " * (depth + 1)
    if is_scalar(dtype):
        return _element(tag, _xml_escape(scalar_text(c, dtype)), self_closing)
    if isinstance(dtype, T.StructType):
        parts: list[Column] = []
        for f in dtype.fields:
            parts += [F.lit(inner), xml_text(c.getField(f.name), f.dataType, f.name, self_closing, depth + 1)]
        body = F.when(c.isNotNull(), F.concat(*parts, F.lit(outer))) if parts else F.lit("")
        return _element(tag, body, self_closing)
    items = F.transform(c, lambda x, i: xml_text(
        x, dtype.elementType, F.concat(tag, F.lit("_"), i.cast("string")), self_closing, depth + 1))
    body = F.when(F.size(c) > 0, F.concat(F.lit(inner), F.array_join(items, inner), F.lit(outer)))
    return _element(tag, body, self_closing)


# -- CSV ------------------------------------------------------------------------------------
def csv_cell(c: Column) -> Column:
    """Quoted only when the text has a comma, a quote or a line break."""
    return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(cells: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_cell(F.coalesce(c, F.lit(""))) for c in cells])


def flat_pairs(c: Column, dtype: T.DataType, label: Column | None, delim: str = ".", as_json: bool = False) -> Column:
    """(key, value) pairs of one record, with only the array indexes the record has."""

    def one(value: Column) -> Column:
        return F.array(F.struct(label.alias("key"), F.coalesce(value, F.lit("")).alias("value")))

    def below(name: str) -> Column:
        return F.lit(name) if label is None else F.concat(label, F.lit(delim + name))

    if isinstance(dtype, T.StructType) and (label is None or not as_json):
        parts = F.concat(*[flat_pairs(c.getField(f.name), f.dataType, below(f.name), delim, as_json) for f in dtype.fields])
        return parts if label is None else F.when(c.isNull(), one(F.lit(""))).otherwise(parts)
    if is_scalar(dtype):
        return one(scalar_text(c, dtype))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType) and not as_json:
        items = F.flatten(F.transform(c, lambda x, i: flat_pairs(
            x, dtype.elementType, F.concat(label, F.lit(delim), i.cast("string")), delim, as_json)))
        return F.when(F.size(c) > 0, items).otherwise(one(F.to_json(c)))
    return one(F.to_json(c))


def csv_text(c: Column, dtype: T.StructType, delim: str = ".", as_json: bool = False) -> Column:
    """Header line and data line of one record."""
    pairs = flat_pairs(c, dtype, None, delim, as_json)
    header = F.array_join(F.transform(pairs, lambda p: csv_cell(p["key"])), ",")
    return F.concat(header, F.lit("\n"), F.array_join(F.transform(pairs, lambda p: csv_cell(p["value"])), ","))


# -- YAML -----------------------------------------------------------------------------------
@F.pandas_udf(T.StringType())
def _yaml(documents: pd.Series) -> pd.Series:
    import yaml
    return documents.map(lambda t: yaml.safe_dump(json.loads(t), sort_keys=False, allow_unicode=True))


def compact_json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def yaml_text(c: Column) -> Column:
    """YAML document of a record; there is no JVM writer, so this is an Arrow-batched call."""
    return _yaml(compact_json(c))


def yaml_scalar(c: Column) -> Column:
    """A text in double quotes, whatever its characters, or a plain number or null, as part of a YAML document.

    JSON escapes are YAML's; what only YAML takes for a line break or not at all is escaped besides.
    """
    item = F.to_json(F.array(c))
    item = item.substr(F.lit(2), F.length(item) - 2)
    special = r"[\x7f-\x9f\u2028\u2029\ufeff\ufffe\uffff]"
    escaped = F.transform(F.split(item, ""), lambda x: F.when(
        x.rlike(special), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(x)), 4, "0"))).otherwise(x))
    return F.when(item.rlike(special), F.array_join(escaped, "")).otherwise(item)


def render(c: Column, dtype: T.StructType, fmt: str, *, root_tag: str = "root", self_closing: bool = True,
           delim: str = ".", nested_as_json: bool = False) -> Column:
    """One record in one of the five formats."""
    if fmt == "xml":
        return xml_text(c, dtype, root_tag, self_closing)
    if fmt == "csv":
        return csv_text(c, dtype, delim, nested_as_json)
    if fmt == "yaml":
        return yaml_text(c)
    if fmt in ("json", "txt"):
        return json_text(c, dtype)
    raise ValueError(f"unknown format {fmt!r}")
