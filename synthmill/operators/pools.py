"""Bank values of leaves, however many: few as literals of the plan, many joined by their place.

A leaf draws a place in its values.  Up to ``literals`` values are carried by the generation plan.  Of more, the plan holds
what they look like (an aggregation over all of them) and their number; each draw of a row is joined with the values by
its place.  Both ways give the same records.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from synthmill.functions.draws import DIGITS, LOWER, UPPER
from synthmill.functions.kinds import BOOL, NUMERIC_KINDS, WHITESPACE, Pattern, trim
from synthmill.functions.lineage import kept
from synthmill.operators.bank import VALUES_PER_KEY, category_id
from synthmill.operators.infer import detect_kinds
from synthmill.schema import Schema

#: A number as generation reads it: without signs, commas and percent.
_LOOSE, _NUMBER = r"[$€£,%]", r"^-?[0-9]+(\.[0-9]+)?$"


def _best_first() -> list[Column]:
    return [F.desc("best.key"), F.desc("best.use_count"), F.desc("best.last_used_at"), F.asc("value")]


@dataclass(frozen=True)
class Pool:
    """The values of one leaf: their pattern, how many fit its kind, and the place of the schema's sample among them.

    ``pattern.samples`` has only the first template, the roomiest one, and one without "@" if there is any.
    """

    pattern: Pattern
    size: int
    sample: str = ""
    own: int | None = None

    @property
    def templates(self) -> int:
        """The sample, where there is one, comes before the other values."""
        return self.size + (1 if self.sample and self.own is None else 0)

    def template_place(self, pick: Column) -> Column:
        """Place among the values of a template; NULL for the sample."""
        if not self.sample:
            return pick
        after = pick - 1 if self.own is None else pick - 1 + (pick > self.own).cast("long")
        return F.when(pick > 0, after)


@dataclass(frozen=True)
class Pools:
    """By path: ``few`` values as they are, ``many`` by what they look like; ``values`` (place, value) of the many."""

    few: dict[str, list[str]]
    many: dict[str, Pool]
    values: dict[str, DataFrame]


def _by_path(spark, pairs: list[tuple], ddl: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(pairs, ddl))


def all_values(bank: DataFrame, schema: Schema) -> DataFrame:
    """(path, value, best): the values of all read keys of each leaf, each where it comes first (see ``_best_first``)."""
    keys = [(path, key.lower(), i) for path, f in schema.leaves() for i, key in enumerate(f.read_keys(path))]
    # The keys are given twice: as a list they reach the scan of the bank, below its aggregation.
    read = F.lower("key_name").isin(sorted({key for _, key, _ in keys}))
    own = bank.where(read & (F.col("category_id") == category_id(F.col("key_name")))).select(
        F.lower("key_name").alias("key"), trim(F.col("value")).alias("value"), "use_count", "last_used_at")
    best = F.struct((-F.col("i")).alias("key"), "use_count", "last_used_at")
    found = own.where("value <> ''").join(_by_path(bank.sparkSession, keys, "path string, key string, i int"), "key")
    return found.groupBy("path", "value").agg(F.max(best).alias("best"))


def _fits(kind: Column) -> Column:
    value = F.col("value")
    return (F.when(kind == "bool", value.rlike(BOOL)).when(kind.isin(*NUMERIC_KINDS), F.regexp_replace(value, _LOOSE, "").rlike(_NUMBER))
            .otherwise(True))


def _room(text: Column) -> Column:
    """Logarithm of the number of values of a template."""
    out = F.lit(0.0)
    for alphabet, pattern in ((DIGITS, "[^0-9]"), (LOWER, "[^a-z]"), (UPPER, "[^A-Z]")):
        out = out + F.length(F.regexp_replace(text, pattern, "")) * F.log(F.lit(float(len(alphabet))))
    return out


def _pattern(r, samples: tuple[str, ...]) -> Pattern:
    numeric = r["kind"] in NUMERIC_KINDS
    low, high = (Fraction(repr(r[c])) if r[c] is not None else Fraction(other) for c, other in (("min_num", 0), ("max_num", 999)))
    return Pattern(r["kind"], samples, r["min_len"], r["max_len"], low if numeric else None, high if numeric else None,
                   r["decimals"] or 0, r["pad_width"] or 0, r["prefix"] or "", bool(r["thousands"]))


def pools(bank: DataFrame, schema: Schema, order: str = "intent", literals: int = VALUES_PER_KEY) -> Pools:
    """The whole bank of every leaf of the schema.

    The driver holds ``literals`` values of a leaf at most, and a row for each leaf and task of the sort.
    """
    spark = bank.sparkSession
    values = kept(all_values(bank, schema), "pool")
    counts = {r["path"]: r["count"] for r in values.groupBy("path").count().collect()}
    short, long = [p for p, n in counts.items() if n <= literals], [p for p, n in counts.items() if n > literals]
    few: dict[str, list[str]] = {}
    for r in values.where(F.col("path").isin(short)).orderBy(*_best_first()).collect() if short else []:
        few.setdefault(r["path"], []).append(r["value"])
    if not long:
        return Pools(few, {}, {})
    samples = {p: (f.sample or "").strip(WHITESPACE) for p, f in schema.leaves() if p in long}
    limits = {p: f.max_length for p, f in schema.leaves() if p in long}
    values = values.where(F.col("path").isin(long)) if short else values
    stats = {r["path"]: r for r in detect_kinds(values, spark.createDataFrame(list(samples.items()), "path string, sample string"), order=order).collect()}
    kinds = _by_path(spark, [(p, stats[p]["kind"]) for p in long], "path string, kind string")
    # Sorted once over all tasks: an id is the number of its task and the place in it, so a place is the id less what
    # the earlier tasks (and the earlier leaves of its own) have before it.
    fitting = values.join(kinds, "path").where(_fits(F.col("kind"))).orderBy("path", *_best_first()).select("path", "value")
    sorted_ = kept(fitting.withColumn("id", F.monotonically_increasing_id()), "pool-sorted", "path")
    traits = _by_path(spark, [(p, samples[p], limits[p]) for p in long], "path string, sample string, limit int")
    cut = F.substring("value", F.lit(1), F.coalesce("limit", F.length("value")))
    parts = (sorted_.join(traits, "path").groupBy("path", F.shiftright("id", _TASK_BITS).alias("task")).agg(
        F.count("*").alias("size"), F.min("id").alias("low"), F.min_by("value", "id").alias("first"),
        F.max(_room(cut)).alias("room"), F.max_by("value", F.struct(_room(cut).alias("room"), (-F.col("id")).alias("id"))).alias("roomy"),
        F.min_by("value", F.when(~F.contains("value", F.lit("@")), F.col("id"))).alias("bare"),
        F.min(F.when(F.col("value") == F.col("sample"), F.col("id"))).alias("own")).collect())
    many, placed = {}, {}
    for path in long:
        mine = sorted((r for r in parts if r["path"] == path), key=lambda r: r["task"])
        size, own, shift = 0, None, {}
        for r in mine:
            shift[r["task"]] = r["low"] - size
            own = r["own"] - r["low"] + size if r["own"] is not None else own
            size += r["size"]
        texts = [samples[path]]
        if mine:
            bare = next((r["bare"] for r in mine if r["bare"] is not None), None)
            texts += [mine[0]["first"], max(mine, key=lambda r: r["room"])["roomy"], bare]
        many[path] = Pool(_pattern(stats[path], tuple(dict.fromkeys(t for t in texts if t))), size, samples[path], own)
        by_task = F.get(F.lit([shift.get(t, 0) for t in range(max(shift, default=0) + 1)]), F.shiftright("id", _TASK_BITS).cast("int"))
        placed[path] = sorted_.where(F.col("path") == path).select((F.col("id") - by_task).alias("place"), "value")
    return Pools(few, many, placed)


#: ``monotonically_increasing_id`` holds the number of the task above so many bits.
_TASK_BITS = 33


def drawn(rows: DataFrame, row_id: str, wanted: list[tuple[int, str, Column]], values: dict[str, DataFrame], name: str) -> DataFrame:
    """``rows`` with an array ``name`` of the values they draw, by the number of the draw.

    ``wanted`` has (number, path, place) of the draws of a row; a NULL place is a draw that a row does not use.  Each draw is
    one join with the values of its path: rows are neither multiplied nor regrouped, so they may be a stream, and small
    values are broadcast by size.  Rows that draw nothing get places below zero of their own, so that no task has them all.
    """
    if not wanted:
        return rows
    spread = F.lit(-1).cast("long") - F.pmod(F.col(row_id).cast("long"), F.lit(1 << 40))
    found: dict[int, Column] = {}
    for number, path, place in wanted:
        own = values[path].select(F.col("place").alias(f"__place{number}"), F.col("value").alias(f"__value{number}"))
        rows = rows.join(own, F.coalesce(place, spread) == own[f"__place{number}"], "left")
        found[number] = F.col(f"__value{number}")
    none = F.lit(None).cast("string")
    taken = F.array(*[found.get(i, none) for i in range(max(found) + 1)])
    return rows.withColumn(name, taken).drop(*[f"__{kind}{number}" for number in found for kind in ("place", "value")])
