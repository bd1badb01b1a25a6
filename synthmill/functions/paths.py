"""Dot paths over typed columns and untyped documents."""

from __future__ import annotations

from pyspark.sql import Column, types as T, functions as F

from synthmill.functions.kinds import trim


def _parts(path: str) -> list[str]:
    return [p for p in path.split(".") if p]


def _dtype(schema: T.StructType, parts: list[str]) -> T.DataType | None:
    """Type at a path, None when a segment is missing or lies behind an array."""
    dtype: T.DataType = schema
    for part in parts:
        if not isinstance(dtype, T.StructType) or part not in dtype.names:
            return None
        dtype = dtype[part].dataType
    return dtype


def get_path(schema: T.StructType, path: str) -> Column:
    """Value at a path; NULL when it does not exist or leads through an array."""
    parts = _parts(path)
    if not parts or _dtype(schema, parts) is None:
        return F.lit(None).cast("string")
    out = F.col(f"`{parts[0]}`")
    for part in parts[1:]:
        out = out.getField(part)
    return out


def set_path(schema: T.StructType, path: str, value: Column) -> tuple[str, Column]:
    """(top-level column, new value) with the path set; missing or scalar parents become objects."""
    first, *rest = _parts(path)

    def put(current: Column | None, dtype: T.DataType | None, parts: list[str]) -> Column:
        if not parts:
            return value
        head, tail = parts[0], parts[1:]
        if isinstance(dtype, T.StructType):
            inner = dtype[head].dataType if head in dtype.names else None
            grown = current.withField(f"`{head}`", put(current.getField(head) if inner else None, inner, tail))
            fresh = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in dtype.fields if f.name != head],
                             put(None, None, tail).alias(head))
            order = [f.name for f in dtype.fields] + ([] if inner else [head])
            return F.when(current.isNotNull(), grown).otherwise(
                F.struct(*[fresh.getField(n).alias(n) for n in order]))
        return F.struct(put(None, None, tail).alias(head))

    known = schema[first].dataType if first in schema.names else None
    return first, put(F.col(f"`{first}`") if known else None, known, rest)


def path_exists(schema: T.StructType, path: str) -> bool:
    parts = _parts(path)
    return bool(parts) and _dtype(schema, parts) is not None


def document_path_exists(document: Column, path: str) -> Column:
    """Whether an untyped JSON document has the path; a JSON null counts, arrays do not match."""
    steps = "".join(f"['{p}']" for p in _parts(path))
    return F.try_variant_get(F.try_parse_json(document), "$" + steps, "variant").isNotNull()


# -- bank keys of a field, for whole tables of fields --------------------------------------
def write_key(path: Column, pool: Column, override: Column) -> Column:
    """``pool:name`` if pooled, ``override/path`` if the override differs from the leaf, else the path."""
    named, other = trim(F.coalesce(pool, F.lit(""))), trim(F.coalesce(override, F.lit("")))
    leaf = F.substring_index(path, ".", -1)
    return (F.when(named != "", F.concat(F.lit("pool:"), named))
            .when((other != "") & (F.lower(other) != F.lower(leaf)), F.concat(other, F.lit("/"), path))
            .otherwise(path))


def read_keys(path: Column, pool: Column, override: Column, sources: Column) -> Column:
    """Write key, path, mapped keys: trimmed, without blanks or case-insensitive repeats, in order."""
    keys = F.transform(F.concat(F.array(write_key(path, pool, override), path),
                                F.coalesce(sources, F.array().cast("array<string>"))), trim)
    keys = F.filter(keys, lambda k: k != "")
    return F.filter(keys, lambda k, i: F.array_position(F.transform(keys, F.lower), F.lower(k)) == i + 1)
