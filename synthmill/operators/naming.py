"""Names that must not repeat: unique field fragments and file name collisions.

Both rules are defined row by row, each row seeing the names of the rows before it.  They are
solved set-wise: ranks and first occurrences give the names at once, and where no derived name
meets a natural one that is all.  Names can only meet inside a family (the same name without its
trailing numbers), so the rows of families in which two names meet, and of no others, pass once
more, sorted by family and row, through a stream that applies the rule itself.  It remembers
distinct natural names and the numbers given and passed over, not rows.  The number of shuffles is
the same however many names meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from synthmill.functions.lineage import cut
from synthmill.functions.naming import NameContext, Naming, compile_name, field_fragment, split_field, tokens
from synthmill.functions.ranks import grouped_rank

_SUFFIXES = r"(_[0-9]+)+$"


def _met_families(names: DataFrame, name: str, family: Column) -> DataFrame:
    """(family) in which two rows have one name, or none."""
    met = names.groupBy(F.lower(name).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    return cut(met.select(family.alias("family")).distinct())


def _passed_over(rows: DataFrame, heads: DataFrame, families: DataFrame, row: str, run) -> DataFrame:
    """The ``rows`` of ``families`` through ``run``, sorted by family and row; ``heads`` (__family and others) come first."""
    every = rows.unionByName(heads.withColumn("__head", F.lit(True)), allowMissingColumns=True)
    mine = every.join(families.select(F.col("family").alias("__family")), "__family", "left_semi")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    sorted_ = mine.repartition("__family").sortWithinPartitions("__family", F.desc_nulls_last("__head"), row)
    return sorted_.select(*rows.columns, "__head").mapInArrow(run, schema)


def _values(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def _renamed(batch: pa.RecordBatch, name: str, values: list[str | None]) -> pa.RecordBatch:
    """The rows of a batch that are no heads, with other values in one column."""
    head = batch.schema.get_field_index("__head")
    at = batch.schema.get_field_index(name)
    arrays = [*batch.columns[:at], pa.array(values, batch.schema.field(at).type), *batch.columns[at + 1:]]
    out = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
    return out.filter(pc.is_null(out.column(head))).drop_columns(["__head"])


# -- {field:path|unique} --------------------------------------------------------------------
def unique_fragments(df: DataFrame, row: str, fragment: Column, name: str) -> DataFrame:
    """Add ``name``: the fragment, or ``fragment_index``, or ``fragment_index_n`` when it was used before.

    The first use of a fragment is found by one aggregation and joined back by row id, so a fragment
    shared by most rows does not overload a task.
    """
    index = (F.col(row).cast("long") + 1).cast("string")
    base = df.withColumn("__f", fragment)
    base = base.withColumns({
        "__v": F.when(F.col("__f") == "", F.concat(F.lit("v"), index)).otherwise(F.col("__f")),
        "__stem": F.concat(F.when(F.col("__f") == "", F.lit("v")).otherwise(F.col("__f")), F.lit("_"), index)})
    firsts = (base.select(row, F.lower("__v").alias("__key")).groupBy("__key")
              .agg(F.min(row).alias(row)).select(row, F.lit(True).alias("__first")))
    base = base.join(firsts, row, "left").withColumn("__start", F.when(F.col("__first"), 0).otherwise(1)).drop("__first")

    at_once = base.withColumn(name, F.when(F.col("__start") == 0, F.col("__v")).otherwise(F.col("__stem")))
    at_once = at_once.withColumn("__family", F.regexp_replace(F.lower("__v"), _SUFFIXES, ""))
    families = _met_families(at_once, name, F.regexp_replace("key", _SUFFIXES, ""))
    if families.isEmpty():
        return at_once.select(*df.columns, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, natural, derived, numbered = None, set(), set(), set()
        for batch in batches:
            out = []
            for family, value, stem, head in _values(batch, "__family", "__v", "__stem", "__head"):
                if family != now:
                    now, natural, derived, numbered = family, set(), set(), set()
                if head:
                    numbered.add(value)
                    out.append(None)
                    continue
                level, found = 0, value
                while found.lower() in natural or found.lower() in derived:
                    level += 1
                    found = stem if level == 1 else f"{stem}_{level}"
                # A name of one number is met by a natural one only, so most need not be kept.
                if not level:
                    natural.add(found.lower())
                elif level > 1 or value.lower() != family or found.lower() in numbered:
                    derived.add(found.lower())
                out.append(found)
            yield _renamed(batch, name, out)

    heads = at_once.select("__family", F.lower("__v").alias("__v")).where(F.col("__v") != F.col("__family")).distinct()
    one_by_one = _passed_over(at_once, heads, families, row, run)
    others = at_once.join(families.select(F.col("family").alias("__family")), "__family", "left_anti")
    return others.select(*df.columns, name).unionByName(one_by_one.select(*df.columns, name))


# -- file name collisions ----------------------------------------------------------------------
def _stem_and_ext(path: Column) -> tuple[Column, Column]:
    """Path without and with only the extension of its last segment; a leading dot is no extension."""
    ext = F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    return F.left(path, F.length(path) - F.length(ext)), ext


def _family(path: Column) -> Column:
    stem, ext = _stem_and_ext(path)
    return F.concat(F.regexp_replace(stem, _SUFFIXES, ""), F.lit("|"), ext)


def _blocked_by(existing: DataFrame, overwrite: bool) -> DataFrame:
    """(group, n) numbers that files on disk take away: n = 1 is the plain name."""
    path = F.lower("path")
    stem, ext = _stem_and_ext(path)
    number = F.regexp_extract(stem, r"_([1-9][0-9]{0,8})$", 1)
    numbered = existing.where(number != "").select(
        F.concat(F.regexp_replace(stem, r"_[0-9]+$", ""), ext).alias("group"), number.cast("long").alias("n")).where("n > 1")
    plain = existing.select(path.alias("group"), F.lit(1).cast("long").alias("n"))
    return (numbered if overwrite else numbered.unionByName(plain)).distinct()


def _islands(blocked: DataFrame) -> DataFrame:
    """Blocked numbers of a group as runs (first, length), so that long series stay small."""
    ranked = grouped_rank(blocked, ["group"], "n", "rank")
    runs = ranked.groupBy("group", (F.col("n") - F.col("rank")).alias("run")).agg(
        F.min("n").alias("first"), F.count("*").alias("length"))
    return runs.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("first", "length"))).alias("runs"))


def resolve_collisions(df: DataFrame, row: str, path: str, policy: str = "suffix",
                       existing: DataFrame | None = None) -> DataFrame:
    """Make ``path`` unique over the run (case-insensitively) and against ``existing`` paths.

    ``suffix`` appends ``_2``, ``_3`` …; ``skip`` drops later rows of a taken name; ``overwrite`` may
    replace existing files but not files of the same run.
    """
    if policy == "skip":
        firsts = df.groupBy(F.lower(path).alias("__key")).agg(F.min(row).alias(row))
        if existing is not None:
            firsts = firsts.join(existing.select(F.lower("path").alias("__key")).distinct(), "__key", "left_anti")
        return df.join(firsts.select(row), row, "left_semi")
    if policy not in ("suffix", "overwrite"):
        raise ValueError(f"unknown collision policy {policy!r}")

    keyed = df.withColumn("__group", F.lower(path))
    ranked = grouped_rank(keyed, ["__group"], row, "__rank")
    blocked = _blocked_by(existing, policy == "overwrite") if existing is not None else \
        df.select(F.lit("").alias("group"), F.lit(1).cast("long").alias("n")).limit(0)

    runs = _islands(blocked).withColumnRenamed("group", "__group")
    free = F.aggregate(F.coalesce("runs", F.array().cast("array<struct<first:bigint,length:bigint>>")), F.col("__rank"),
                       lambda n, run: F.when(run["first"] <= n, n + run["length"]).otherwise(n))
    stem, ext = _stem_and_ext(F.col(path))
    at_once = ranked.join(runs, "__group", "left").withColumn("__n", free).drop("runs")
    at_once = at_once.withColumns({"__stem": stem, "__ext": ext, "__family": _family(F.col("__group")), "__name": F.when(
        F.col("__n") == 1, F.col(path)).otherwise(F.concat(stem, F.lit("_"), F.col("__n").cast("string"), ext))})
    out_columns = [F.col("__name").alias(path) if c == path else F.col(c) for c in df.columns]
    families = _met_families(at_once, "__name", _family(F.col("key")))
    if families.isEmpty():
        return at_once.select(*out_columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: str | None = None
        given: dict[str, int] = {}  # the last number given in a group; the plain name is number 1
        passed: dict[str, set[int]] = {}  # numbers that others have, of the files there and of this run
        for batch in batches:
            out = []
            for family, group, n, plain, stem, ext, head in _values(batch, "__family", "__group", "__n", path, "__stem", "__ext", "__head"):
                if family != now:
                    now, given, passed = family, {}, {}
                if head:
                    passed.setdefault(group, set()).add(n)
                    out.append(None)
                    continue
                n, over = given.get(group, 0) + 1, passed.setdefault(group, set())
                while n in over or _has(group if n == 1 else f"{stem}_{n}{ext}".lower(), group, given, passed):
                    over.add(n)
                    n += 1
                given[group] = n
                out.append(plain if n == 1 else f"{stem}_{n}{ext}")
            yield _renamed(batch, "__name", out)

    heads = blocked.select(_family(F.col("group")).alias("__family"), F.col("group").alias("__group"), F.col("n").alias("__n"))
    one_by_one = _passed_over(at_once, heads, families, row, run)
    others = at_once.join(families.select(F.col("family").alias("__family")), "__family", "left_anti")
    return others.select(*out_columns).unionByName(one_by_one.select(*out_columns))


def _has(name: str, group: str, given: dict[str, int], passed: dict[str, set[int]]) -> bool:
    """Whether another group has given the name, as its plain one or by its number."""
    if name != group and given.get(name, 0) >= 1 and 1 not in passed.get(name, ()):
        return True
    base = name.rpartition("/")
    dot = base[2].rfind(".")
    stem, ext = (base[2][:dot], base[2][dot:]) if dot > 0 else (base[2], "")
    found = re.fullmatch(r"(.*)_([1-9][0-9]*)", stem, re.S)
    if not found or int(found[2]) < 2:
        return False
    other = f"{base[0]}{base[1]}{found[1]}{ext}"
    return other != group and int(found[2]) <= given.get(other, 0) and int(found[2]) not in passed.get(other, ())


# -- whole run ----------------------------------------------------------------------------------
def name_records(df: DataFrame, row: str, naming: Naming, ctx: NameContext, name: str = "path",
                 existing: DataFrame | None = None) -> DataFrame:
    """Add the final relative path of every record; rows the ``skip`` policy drops are gone."""
    out, resolved = df, {}
    for kind, body in tokens(naming.pattern):
        if kind == "token" and body.lower().startswith("field:"):
            path, flag = split_field(body)
            if flag == "unique" and path.lower() not in resolved:
                column = f"__u{len(resolved)}"
                out = unique_fragments(out, row, field_fragment(df.schema, path), column)
                resolved[path.lower()] = column
    path = compile_name(naming, ctx, F.col(row), lambda p: F.col(resolved[p.lower()]))
    named = out.withColumn(name, path).drop(*resolved.values())
    return resolve_collisions(named, row, name, naming.policy, existing)
