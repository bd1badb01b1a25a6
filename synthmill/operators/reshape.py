"""Flatten, split and unpivot nested frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, types as T, functions as F

from synthmill.functions.draws import div
from synthmill.functions.text import is_scalar, scalar_text
from synthmill.operators.infer import ARRAY
from synthmill.schema import Field

SCHEMA_SLOTS = 4  # array slots of a header that must be known before the data


def _json(c: Column, dtype: T.DataType) -> Column:
    return c if is_scalar(dtype) else F.to_json(c, {"ignoreNullFields": "false"})


def _array_sizes(df: DataFrame, fields: Sequence[T.StructField]) -> dict[str, int]:
    """Longest length of every array of objects, in one aggregation."""
    sizes: dict[str, Column] = {}

    def visit(path: str, c: Column, dtype: T.DataType) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                visit(f"{path}.{f.name}", c.getField(f.name), f.dataType)
        elif isinstance(dtype, T.ArrayType):
            sizes[path] = F.size(c)
            if isinstance(dtype.elementType, T.StructType):
                for f in dtype.elementType.fields:
                    deeper(f"{path}.{f.name}", F.transform(c, lambda x: x.getField(f.name)), f.dataType)

    def deeper(path: str, values: Column, dtype: T.DataType) -> None:
        """Below an array: the longest length over its elements."""
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                deeper(f"{path}.{f.name}", F.transform(values, lambda x: x.getField(f.name)), f.dataType)
        elif isinstance(dtype, T.ArrayType):
            sizes[path] = F.array_max(F.transform(values, F.size))
            if isinstance(dtype.elementType, T.StructType):
                for f in dtype.elementType.fields:
                    deeper(f"{path}.{f.name}", F.transform(F.flatten(values), lambda x: x.getField(f.name)), f.dataType)

    for f in fields:
        visit(f.name, F.col(f"`{f.name}`"), f.dataType)
    if not sizes:
        return {}
    row = df.agg(*[F.max(c).alias(f"s{i}") for i, c in enumerate(sizes.values())]).first()
    return {path: max(row[i] or 0, 0) for i, path in enumerate(sizes)}


def flatten(df: DataFrame, delim: str = ".", *, nested_as_json: bool = False, slots: int | None = None,
            as_text: bool = False) -> DataFrame:
    """One flat column per leaf.

    Objects give ``a.b``; arrays of objects give ``a.0.b`` for every index up to the longest array
    (or ``slots``); arrays of scalars, and every nested value with ``nested_as_json``, become JSON
    text.  With ``as_text`` all columns are text and NULL becomes ''.
    """
    sizes = {} if nested_as_json or slots is not None else _array_sizes(df, df.schema.fields)
    out: list[tuple[str, Column, T.DataType]] = []

    def visit(label: str, path: str, c: Column, dtype: T.DataType) -> None:
        if isinstance(dtype, T.StructType) and not nested_as_json:
            for f in dtype.fields:
                visit(f"{label}{delim}{f.name}", f"{path}.{f.name}", c.getField(f.name), f.dataType)
        elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType) and not nested_as_json:
            for i in range(slots if slots is not None else sizes[path]):
                for f in dtype.elementType.fields:
                    visit(f"{label}{delim}{i}{delim}{f.name}", f"{path}.{f.name}", F.get(c, F.lit(i)).getField(f.name), f.dataType)
        else:
            out.append((label, _json(c, dtype), T.StringType() if not is_scalar(dtype) else dtype))

    for f in df.schema.fields:
        visit(f.name, f.name, F.col(f"`{f.name}`"), f.dataType)
    if as_text:
        return df.select(*[F.coalesce(scalar_text(c, t), F.lit("")).alias(n) for n, c, t in out])
    return df.select(*[c.alias(n) for n, c, _ in out])


def schema_headers(fields: Sequence[Field], delim: str = ".", *, nested_as_json: bool = False,
                   slots: int = SCHEMA_SLOTS) -> list[str]:
    """Flat column names of a schema, known before any row; scalar arrays are one JSON column."""
    out: dict[str, None] = {}

    def visit(f: Field, prefix: str) -> None:
        label = f"{prefix}{delim}{f.name}" if prefix else f.name
        if f.is_leaf or nested_as_json or not f.children or f.holds_scalars:
            out[label] = None
        elif f.kind == ARRAY:
            for i in range(slots):
                for c in f.children:
                    visit(c, f"{label}{delim}{i}")
        else:
            for c in f.children:
                visit(c, label)

    for f in fields:
        visit(f, "")
    return list(out)


def nested_as_json(df: DataFrame) -> DataFrame:
    """Every nested column as JSON text, scalars unchanged."""
    return df.select(*[_json(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def union_headers(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all flat frames under the union of their columns; what is absent is ''."""
    texts = [df.select(*[scalar_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]) for df in frames]
    out = texts[0]
    for df in texts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.na.fill("")


RECORD = "_record"  # record id in every entity frame


def position_column(array: str) -> str:
    """Column that holds the element position below an array."""
    return f"_{array}_pos"


def entity_split(df: DataFrame, row: str, delim: str = ".", *, as_json: bool = False) -> dict[str, DataFrame]:
    """One frame per entity: ``root`` and every nested object or array, named by path.

    Each frame starts with ``_record``, the value of ``row``, and one ``_<array>_pos`` per enclosing
    array; then follow the entity's scalars.  Array elements that are scalars give a ``value`` column.
    An entity without scalars is left out.  With ``as_json`` there is only ``root``, with nested values
    as JSON text.
    """
    if as_json:
        return {"root": nested_as_json(df).select(F.col(row).alias(RECORD), "*")}
    out: dict[str, DataFrame] = {}

    def emit(name: str, rows: DataFrame, keys: list[str], fields: list[T.StructField], base: Column | None) -> None:
        def value(f: T.StructField) -> Column:
            return F.col(f"`{f.name}`") if base is None else base.getField(f.name)

        scalars = [f for f in fields if is_scalar(f.dataType)]
        if scalars:
            out[name] = rows.select(*keys, *[value(f).alias(f.name) for f in scalars])
        nested = [f for f in fields if isinstance(f.dataType, T.StructType)]
        nested += [f for f in fields if isinstance(f.dataType, T.ArrayType)]
        for f in nested:
            child = f.name if name == "root" else f"{name}{delim}{f.name}"
            if isinstance(f.dataType, T.StructType):
                below = rows.select(*keys, value(f).alias("__v")).where("__v IS NOT NULL")
                emit(child, below, keys, f.dataType.fields, F.col("__v"))
                continue
            pos = position_column(f.name)
            below = rows.select(*keys, F.posexplode(value(f)).alias(pos, "__v"))
            item = f.dataType.elementType
            if isinstance(item, T.StructType):
                emit(child, below, [*keys, pos], item.fields, F.col("__v"))
            else:
                out[child] = below.select(*keys, pos, _json(F.col("__v"), item).alias("value"))

    emit("root", df.select(F.col(row).alias(RECORD), "*"), [RECORD], df.schema.fields, None)
    return out


def per_key(df: DataFrame, row: str) -> DataFrame:
    """(key, row, value): every column as a block of its values in row order."""
    flat = flatten(df.select(row, *[c for c in df.columns if c != row]), as_text=True)
    names = [c for c in flat.columns if c != row]
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"`{n}`").alias("value")) for n in names])
    return flat.select(F.col(row).cast("long").alias(row), F.inline(pairs))


def first_only(df: DataFrame, row: str) -> DataFrame:
    return df.orderBy(row).limit(1)


def split_n(df: DataFrame, index: str, n: int, total: int | None = None) -> DataFrame:
    """Add ``batch``: n contiguous batches of ceil(total / n) rows, by the dense 0-based index."""
    total = df.count() if total is None else total
    size = max(-(-total // max(n, 1)), 1)
    return df.withColumn("batch", div(F.col(index).cast("long"), size))
