"""Infer schemas, values and format kinds from typed frames and from untyped JSON documents.

Both kinds of input become one long table of leaves ``(pos, i, steps, kind, value)``: ``pos`` is
the caller's record position, ``i`` orders the leaves of a record, ``steps`` is the path with
``[]`` for "each element".  Everything else is an aggregation of that table, combined before the
shuffle, so neither a frequent value nor a field that dominates the input is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, types as T, functions as F

from synthmill.functions.kinds import (
    INT_PADDED, kind_columns, loose_number, match_flags, trim)
from synthmill.functions.text import is_scalar, scalar_text
from synthmill.schema import ARRAY, OBJECT, VALUE, Field, Schema

EACH = "[]"
#: Depth up to which a text's brackets are believed without parsing it.
PLAUSIBLE_DEPTH = 16

# Names that mark a key column.
PRIMARY_NAME = r"^(?i:id|_id|.*_id|uuid|guid)$"
UNIQUE_NAME = r"^(?i:id|_id|uuid|guid)$"


# -- leaves ---------------------------------------------------------------------------------
def _leaf_structs(c: Column, dtype: T.DataType, steps: list[str]) -> Column:
    """Array of (steps, kind, value) for everything below one column."""
    def one(kind: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(steps).alias("steps"), F.lit(kind).alias("kind"), value.alias("value")))

    nothing = F.lit(None).cast("string")
    if isinstance(dtype, T.StructType):
        parts = [_leaf_structs(c.getField(f.name), f.dataType, [*steps, f.name]) for f in dtype.fields]
        return F.when(c.isNotNull(), F.concat(*parts)).otherwise(one(VALUE, nothing))
    if isinstance(dtype, T.ArrayType):
        inner = F.flatten(F.transform(c, lambda x: _leaf_structs(x, dtype.elementType, [*steps, EACH])))
        return F.when(c.isNull(), one(VALUE, nothing)).when(F.size(c) == 0, one(ARRAY, nothing)).otherwise(inner)
    return one(VALUE, scalar_text(c, dtype))


def leaves(df: DataFrame, pos: str, by: Sequence[str] = ()) -> DataFrame:
    """Leaves of a typed frame; ``pos`` and ``by`` columns are not leaves themselves."""
    fields = [f for f in df.schema.fields if f.name not in (pos, *by)]
    parts = [_leaf_structs(F.col(f"`{f.name}`"), f.dataType, [f.name]) for f in fields]
    rows = df.select(*by, F.col(pos).alias("pos"), F.posexplode(F.concat(*parts)).alias("i", "leaf"))
    return rows.select(*by, "pos", F.array("i").alias("at"), "leaf.*")


def nesting(document: Column) -> Column:
    """Levels of brackets of a JSON text, those within its strings aside."""
    brackets = F.regexp_replace(document, r'"[^"\\]*+(?:(?s:\\.)[^"\\]*+)*+"|[^\[\]{}"]++', "")

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("{", "["), 1).otherwise(F.when(c.isin("}", "]"), -1).otherwise(0))
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.split(brackets, ""), start, step, lambda a: a["most"])


def deepest(df: DataFrame, document: str) -> int:
    """The deepest nesting of the JSON documents of a column: one number from one pass, without a shuffle of the documents."""
    levels = nesting(F.col(document))
    found = df.select(F.col(document).alias("d"), levels.alias("n"))
    told = F.when((F.col("n") <= PLAUSIBLE_DEPTH) | F.try_parse_json("d").isNotNull(), F.col("n"))
    return found.agg(F.max(told)).first()[0] or 0


def document_leaves(df: DataFrame, document: str, pos: str, by: Sequence[str] = (), depth: int | None = None) -> DataFrame:
    """Leaves of JSON documents of any shape and depth.

    A top-level array holds several records; text that is not JSON is left out.  Documents are
    unfolded one level per step, all in one stage without a shuffle, as many levels as the deepest
    has; a pass over the documents finds that out, unless ``depth`` says it.  A document deeper
    than a given depth raises an error instead of losing values.
    """
    depth = deepest(df, document) if depth is None else depth
    explode = df.sparkSession.tvf.variant_explode_outer

    def shape(v: str, prefix: str) -> Column:
        return F.startswith(F.schema_of_variant(v), F.lit(prefix))

    out = df.select(*by, F.col(pos).alias("pos"), F.try_parse_json(document).alias("v")).where("v IS NOT NULL")
    out = out.withColumn("list", F.when(shape("v", "ARRAY<"), F.col("v")))
    out = out.lateralJoin(explode(F.col("list").outer()).toDF("p", "k", "n")).select(
        *by, "pos", F.coalesce("n", "v").alias("v"), F.array(F.coalesce("p", F.lit(0))).alias("at"))
    out = out.withColumn("steps", F.when(shape("v", "OBJECT<"), F.array().cast("array<string>")).otherwise(F.array(F.lit("value"))))
    for _ in range(depth):
        moved = F.col("p").isNotNull()
        out = out.lateralJoin(explode(F.col("v").outer()).toDF("p", "k", "n")).select(
            *by, "pos", F.coalesce("n", "v").alias("v"),
            F.when(moved, F.array_append("at", F.col("p"))).otherwise(F.col("at")).alias("at"),
            F.when(moved, F.array_append("steps", F.coalesce("k", F.lit(EACH)))).otherwise(F.col("steps")).alias("steps"))
    empty = F.to_json("v").isin("{}", "[]")
    nested = shape("v", "OBJECT<") | shape("v", "ARRAY<")
    deeper = F.raise_error(F.lit(f"document nested deeper than {depth} levels")).cast("string")
    kind = (F.when(nested & ~empty, deeper).when(shape("v", "OBJECT<"), OBJECT)
            .when(shape("v", "ARRAY<"), ARRAY).otherwise(VALUE))
    # The check sits in the value column too, so that pruning "kind" cannot skip it.
    value = F.when(nested & ~empty, deeper).when(~nested, F.col("v").cast("string"))
    return out.select(*by, "pos", "at", "steps", kind.alias("kind"), value.alias("value"))


def path_of(steps: Column) -> Column:
    """Dot path: array steps vanish, scalars inside an array are called ``item``."""
    names = F.filter(steps, lambda s: s != EACH)
    return F.array_join(F.when(F.element_at(steps, -1) == EACH, F.array_append(names, F.lit("item"))).otherwise(names), ".")


def leaf_paths(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct dot paths of value leaves."""
    return rows.where(F.col("kind") == VALUE).select(*by, path_of(F.col("steps")).alias("path")).distinct()


def normalize(df: DataFrame, column: str, pos: str) -> DataFrame:
    """Array column to one row per element; elements that are not objects become ``{value}``."""
    dtype = df.schema[column].dataType
    if not isinstance(dtype, T.ArrayType):
        return df.select(pos, F.lit(0).alias("at"), F.col(column).alias("value")) if is_scalar(dtype) \
            else df.select(pos, F.lit(0).alias("at"), f"{column}.*")
    rows = df.select(pos, F.posexplode(column).alias("at", "value"))
    return rows.select(pos, "at", "value.*") if isinstance(dtype.elementType, T.StructType) else rows


def harvest_values(rows: DataFrame, by: Sequence[str] = (), cap: int | None = None) -> DataFrame:
    """Distinct trimmed values per path: all of them, as (path, value, seen), or the first ``cap``, as (path, rank, value).

    Repeats are combined before the first shuffle and the cap is applied in every task before
    the second, so a path that holds most values costs no more than any other.
    """
    texts = rows.where(F.col("kind") == VALUE).select(
        *by, path_of(F.col("steps")).alias("path"), trim(F.col("value")).alias("value"), F.struct("pos", "at").alias("seen"))
    first = texts.where(F.col("value") != "").groupBy(*by, "path", "value").agg(F.min("seen").alias("seen"))
    order = W.partitionBy(*by, "path").orderBy("seen", "value")
    if cap is None:
        return first.select(*by, "path", "value", "seen")
    ranked = first.select(*by, "path", "value", F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= cap)


def scan_counts(df: DataFrame) -> DataFrame:
    """Records of a frame and how many of them inference reads: all."""
    n = F.count("*")
    return df.agg(n.alias("records"), n.alias("scanned"))


def merge_shapes(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per leaf path and form: the first non-empty value over all records."""
    seen = F.struct("pos", "at", "value")
    filled = (F.col("kind") != VALUE) | (F.col("value") != "")
    return (rows.groupBy(*by, "steps", "kind")
            .agg(F.min(F.when(filled, seen)).alias("first"), F.min(seen).alias("any"))
            .select(*by, "steps", path_of(F.col("steps")).alias("path"), "kind",
                    F.col("first.value").alias("sample"), F.col("first.pos").alias("first_pos"),
                    F.struct("any.pos", "any.at").alias("seen"), F.col("first").isNotNull().alias("filled")))


def flag_keys(name: Column) -> tuple[Column, Column]:
    """(is primary, is unique) by the name of a leaf."""
    return name.rlike(PRIMARY_NAME), name.rlike(UNIQUE_NAME)


def schema_rows(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The schema as a table: (path, name, kind, sample, is_primary, is_unique, sort_order).

    An array form of a path wins; otherwise the form that was first seen filled.
    """
    merged = merge_shapes(rows, by)
    n = F.size("steps")
    element = F.element_at("steps", n) == EACH

    def node(i: Column) -> Column:
        following = F.get(F.col("steps"), i)
        kind = F.when(i == n, F.col("kind")).when(following == EACH, ARRAY).otherwise(OBJECT)
        here = F.slice("steps", F.lit(1), i)
        return F.struct(F.filter(here, lambda s: s != EACH).alias("names"), kind.alias("kind"), (i == n).alias("own"))

    item = F.struct(F.array_append(F.filter("steps", lambda s: s != EACH), F.lit("item")).alias("names"),
                    F.col("kind").alias("kind"), F.lit(True).alias("own"))
    named = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.element_at("steps", i) != EACH, node(i))),
                     lambda x: x.isNotNull())
    nodes = F.when(element, F.array_append(named, item)).otherwise(named)
    flat = merged.select(*by, "sample", "seen", "filled", F.explode(nodes).alias("n")).select(
        *by, F.array_join("n.names", ".").alias("path"), F.element_at("n.names", -1).alias("name"),
        F.array_join(F.slice("n.names", F.lit(1), F.size("n.names") - 1), ".").alias("parent"),
        "n.kind", F.when(F.col("n.own"), F.col("sample")).alias("sample"), "seen", "filled")
    strength = F.struct((F.col("kind") != ARRAY).alias("later"), (~F.col("filled")).alias("blank"), "seen")
    shaped = flat.groupBy(*by, "path", "name", "parent").agg(
        F.min_by("kind", strength).alias("kind"), F.min("seen").alias("seen"),
        F.min_by("sample", F.when(F.col("sample").isNotNull() & (F.col("kind") == VALUE), F.struct("seen", "sample"))).alias("sample"))
    primary, unique = flag_keys(F.col("name"))
    leaf = F.col("kind") == VALUE
    order = F.row_number().over(W.partitionBy(*by, "parent").orderBy("seen", "name")) - 1
    return shaped.select(*by, "path", "name", "parent", "kind", F.when(leaf, F.col("sample")).alias("sample"),
                         (leaf & primary).alias("is_primary"), (leaf & unique).alias("is_unique"),
                         order.alias("sort_order"))


def to_schema(table: DataFrame, name: str) -> Schema:
    """Build the driver-side tree from a schema table (its size is that of the schema)."""
    rows = sorted(table.collect(), key=lambda r: r["sort_order"])
    children: dict[str, list] = {}
    for r in rows:
        children.setdefault(r["parent"], []).append(r)

    def build(parent: str) -> tuple[Field, ...]:
        out = []
        for r in children.get(parent, ()):
            kids = build(r["path"]) if r["kind"] != VALUE else ()
            out.append(Field(r["name"], r["kind"], r["sample"] if r["kind"] == VALUE else None,
                             is_primary=r["is_primary"], is_unique=r["is_unique"],
                             relationship="one-to-many" if r["kind"] == ARRAY else None, children=kids))
        return tuple(out)

    return Schema(name, build("") or (Field("field", sample=""),))


def schema_samples(table: DataFrame, key: Column) -> DataFrame:
    """(category, key_name, value) of all leaves with a non-blank sample."""
    filled = (F.col("kind") == VALUE) & (trim(F.coalesce("sample", F.lit(""))) != "")
    return table.where(filled).select(key.alias("category"), key.alias("key_name"), F.col("sample").alias("value"))


def umbrella_rows(table: DataFrame, package: Sequence[str], member: str) -> DataFrame:
    """Schema rows of all members of a package as one tree: an object per member, its rows below."""
    root = F.struct(F.col(member).alias("path"), F.col(member).alias("name"), F.lit("").alias("parent"),
                    F.lit(OBJECT).alias("kind"))
    tops = table.select(*package, member).distinct().select(*package, root.alias("r")).select(*package, "r.*")
    below = F.concat_ws("/", F.col(member), F.col("path"))
    return tops.unionByName(table.select(
        *package, below.alias("path"), "name",
        F.when(F.col("parent") == "", F.col(member)).otherwise(F.concat_ws("/", member, "parent")).alias("parent"), "kind"))


# -- format kinds ---------------------------------------------------------------------------
def _flag(kind: str) -> str:
    return f"is_{kind.replace('-', '_')}"


def detect_kinds(values: DataFrame, samples: DataFrame | None = None, by: Sequence[str] = ("path",),
                 order: str = "intent") -> DataFrame:
    """Format kind and statistics per path, from (path, value) rows and optional (path, sample).

    A single aggregation over all rows; values need not be distinct.  All its buffers are of fixed
    width, which keeps it a hash aggregation: texts, such as the samples, are joined afterwards.
    """
    rows = values.select(*by, trim(F.col("value")).alias("value"))
    if samples is not None:
        own = samples.select(*by, trim(F.col("sample")).alias("sample")).where("sample <> ''")
        own = own.groupBy(*by).agg(F.max("sample").alias("sample"))
        rows = rows.unionByName(own.withColumnRenamed("sample", "value"))
    v = F.col("value")
    flags = match_flags(v)
    # Flags and numbers become columns first, so that the aggregates below do not repeat the tests.
    rows = rows.where(v != "").select(*by, "value", *[c.alias(_flag(n)) for n, c in flags.items()])
    plain, money = F.col(_flag("int")) | F.col(_flag("float")), F.col(_flag("currency")) | F.col(_flag("percent"))
    number = F.when(plain, v.try_cast("double")).when(money, loose_number(v))
    whole = F.col(_flag("int"))
    rows = rows.select(
        "*", number.alias("number"),
        F.when(plain | money, F.length(F.regexp_extract(v, r"\.([0-9]+)", 1))).alias("places"),
        F.when(whole, F.length(v) - F.startswith(v, F.lit("-")).cast("int")).alias("width"),
        (whole & v.rlike(INT_PADDED)).alias("padded"), F.length(v).alias("size"),
        ((plain | money) & F.contains(v, F.lit(","))).alias("comma"), plain.alias("plain"),
        F.nullif(F.instr(F.lit(_SIGNS), F.left(v, F.lit(1))), F.lit(0)).alias("sign"))
    grouped = rows.groupBy(*by).agg(
        *[F.bool_and(_flag(n)).alias(f"all_{_flag(n)}") for n in flags],
        F.bool_or("padded").alias("any_padded"), F.bool_or("comma").alias("any_comma"),
        F.min("sign").alias("sign"),
        F.min("size").alias("min_len"), F.max("size").alias("max_len"),
        F.min("number").alias("min_any"), F.max("number").alias("max_any"),
        F.min(F.when(F.col("plain"), F.col("number"))).alias("min_plain"), F.max(F.when(F.col("plain"), F.col("number"))).alias("max_plain"),
        F.max(F.when(F.col("plain"), F.col("places"))).alias("places_plain"),
        F.min(F.when(whole, F.col("number"))).alias("min_int"), F.max(F.when(whole, F.col("number"))).alias("max_int"),
        F.max("places").alias("places"), F.max("width").alias("width"))
    every = {n: F.col(f"all_{_flag(n)}") for n in flags}
    grouped = grouped.withColumn("sample", F.lit(None).cast("string")) if samples is None else grouped.join(own, [*by], "left")
    kind = kind_columns(every, F.col("any_padded"), F.col("sample"), order)
    return _with_stats(grouped.withColumn("kind", kind), by)


_SIGNS = "$€£"

# Lengths that belong to a kind, whatever the samples.
_FIXED_LENGTHS = {"bool": (4, 5), "date-iso": (10, 10), "datetime-iso": (19, 30), "date-us": (8, 10),
                  "date-eu": (8, 10), "date-slash-ymd": (8, 10), "uuid": (36, 36)}


def _with_stats(g: DataFrame, by: Sequence[str]) -> DataFrame:
    kind = F.col("kind")

    def length(index: int, observed: str) -> Column:
        out = F
        for name, pair in _FIXED_LENGTHS.items():
            out = out.when(kind == name, pair[index])
        return out.otherwise(F.col(observed))

    whole, real = kind.isin("int", "int-padded"), kind.isin("currency", "percent")
    comma = F.col("any_comma") & (kind == "currency")
    places = F.coalesce("places", F.lit(0))
    money = F.greatest(places, F.when(comma, 2).otherwise(0))
    sampled = F.nullif(F.instr(F.lit(_SIGNS), F.left("sample", F.lit(1))), F.lit(0))
    sign = F.coalesce(F.when(F.col("sample").isNotNull(), F.coalesce(sampled, F.lit(1))), F.col("sign"), F.lit(1))
    return g.select(
        *by, "kind", length(0, "min_len").alias("min_len"), length(1, "max_len").alias("max_len"),
        F.when(whole, F.col("min_int")).when(kind == "float", F.col("min_plain")).when(real, F.col("min_any")).alias("min_num"),
        F.when(whole, F.col("max_int")).when(kind == "float", F.col("max_plain")).when(real, F.col("max_any")).alias("max_num"),
        F.when(kind == "percent", places).when(kind == "float", F.greatest(F.coalesce("places_plain", F.lit(0)), F.lit(1)))
        .when(kind == "currency", F.when(money == 0, 2).otherwise(money)).alias("decimals"),
        F.when(kind == "int-padded", F.coalesce(
            F.when(F.col("sample").rlike(INT_PADDED), F.length(F.regexp_replace("sample", "^-", ""))), F.col("width"))).alias("pad_width"),
        F.when(kind == "currency", F.substring(F.lit(_SIGNS), sign, F.lit(1))).alias("prefix"),
        F.when(kind == "currency", comma).alias("thousands"))
