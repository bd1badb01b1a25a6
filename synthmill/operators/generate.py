"""Generate records from a schema: one select over row ids, map-only."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from synthmill.functions import draws as d
from synthmill.operators import counters
from synthmill.operators.leaves import ARRAY_SLOTS, BLANK, DRAWN, MADE, TIED, Address, LeafPlan
from synthmill.operators.pools import Pools, drawn
from synthmill.schema import ARRAY, Field, Schema
from synthmill.session import tune


class SchemaPlan:
    """A schema compiled for one seed.

    ``bank`` maps read key (lower case) to the ranked values of that key; leave it empty for
    output that depends on schema and seed only.  ``pools`` are the values of leaves whatever
    their number, and take the place of ``bank``.  A row depends on its id, never on the number of
    rows: ``rows``, a bound of the ids where one is known, only saves work.  Unique leaves with one
    write key and one form of values share those values out among them.
    ``scope`` keeps the draws of several schemas of one run apart.
    """

    def __init__(self, schema: Schema, seed: int, bank: Mapping[str, Sequence[str]] | None = None,
                 order: str = "intent", scope: str = "", rows: int | None = None, pools: Pools | None = None):
        self.pools = pools or Pools({}, {}, {})
        self.schema, self.seed, self.order, self.rows = schema, seed & 0xFFFFFFFF, order, rows
        self.scope = f"{scope}:" if scope else ""
        self.bank = {k.lower(): v for k, v in (bank or {}).items()}
        self.tied = {p.lower() for p in schema.tied_paths}
        self._leaves: dict[str, LeafPlan] = {}

    def leaf(self, field: Field, path: str, depth: int = 0) -> LeafPlan:
        if path not in self._leaves:
            rows = None if self.rows is None else self.rows * ARRAY_SLOTS ** depth
            self._leaves[path] = LeafPlan(field, self.scope + path, self.seed, self._values(field, path), self.order, self._sharing.get(path), rows,
                                          self.pools.many.get(path), self._firsts.get(path, 0))
        return self._leaves[path]

    def _values(self, field: Field, path: str) -> Sequence[str]:
        """Values that the plan carries for a leaf."""
        return self.pools.few.get(path) or [v for key in field.read_keys(path) for v in self.bank.get(key.lower(), ())]

    @cached_property
    def _places(self) -> dict[str, tuple[Field, int]]:
        """(leaf, number of arrays around it) of every path."""
        out: dict[str, tuple[Field, int]] = {}

        def visit(fields: Sequence[Field], prefix: str, depth: int) -> None:
            for f in fields:
                path = f"{prefix}.{f.name}" if prefix else f.name
                if f.is_leaf:
                    out[path] = f, depth
                visit(f.children, path, depth + (f.kind == ARRAY))
        visit(self.schema.root, "", 0)
        return out

    @cached_property
    def _firsts(self) -> dict[str, int]:
        """First number of the values that a row draws for each leaf of a large pool."""
        out, n = {}, 0
        for path in self.pools.many:
            field, depth = self._places[path]
            out[path] = n
            n += LeafPlan(field, path, self.seed, many=self.pools.many[path]).draws(depth)
        return out

    def wanted(self, row: Column) -> list[tuple[int, str, Column]]:
        """(number, path, place) of all values that a row draws from large pools."""
        out = []
        for path in self.pools.many:
            field, depth = self._places[path]
            if path.lower() in self.tied:
                at = Address(d.long(0), (d.long(0),) * depth, d.long(0))
                places = [(0, at)] if not field.sample else []
            else:
                places = [(slot, Address(d.long(row), tuple(d.long(i) for i in idx)))
                          for slot, idx in enumerate(itertools.product(range(ARRAY_SLOTS), repeat=depth))]
            for slot, at in places:
                out += [(n, path, place) for n, place in self.leaf(field, path, depth).wanted(at, slot)]
        return out

    @cached_property
    def _sharing(self) -> dict[str, tuple[str, int, int]]:
        """(key, place, number) of the unique leaves that share their values."""
        groups: dict[tuple, list[str]] = {}
        for path, f in self.schema.leaves():
            if f.unique and not f.enum and path.lower() not in self.tied:
                space = LeafPlan(f, self.scope + path, self.seed, self._values(f, path), self.order, many=self.pools.many.get(path)).unique_space
                groups.setdefault((f.write_key(path).lower(), repr(space)), []).append(path)
        return {path: (f"{self.scope}key:{key}", i, len(paths)) for (key, _), paths in groups.items() if len(paths) > 1
                for i, path in enumerate(paths)}

    def columns(self, row: Column) -> list[Column]:
        at = Address(d.long(row), (), d.long(row))
        return [self._column(f, "", at).alias(f.name) for f in self.schema.root]

    def _column(self, f: Field, prefix: str, at: Address) -> Column:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if f.kind == ARRAY:
            return self._array(f, path, at)
        if not f.is_leaf:
            return F.struct(*[self._column(c, path, at).alias(c.name) for c in f.children]) \
                if f.children else F.lit(None).cast("string")
        plan = self.leaf(f, path, len(at.idx))
        if path.lower() in self.tied:
            fixed = plan.tied_value()
            if fixed is not None:
                return fixed
            zero = tuple(d.long(0) for _ in at.idx)
            return plan.compile(Address(d.long(0), zero, d.long(0))).value
        return plan.compile(at).value

    def array_size(self, path: str, at: Address) -> Column:
        return d.below(d.draw(d.draw_key(self.seed, self.scope + path, "size"), at.row, idx=at.idx), ARRAY_SLOTS) + 1

    def element_address(self, at: Address, i: Column) -> Address:
        return Address(at.row, (*at.idx, i), at.ordinal * d.long(ARRAY_SLOTS) + i)

    def _array(self, f: Field, path: str, at: Address) -> Column:
        size = self.array_size(path, at).cast("int")

        def element(i: Column) -> Column:
            inner = self.element_address(at, d.long(i))
            if not f.children:
                return F.lit(None).cast("string")
            if f.holds_scalars:
                return self._column(f.children[0], path, inner)
            return F.struct(*[self._column(c, path, inner).alias(c.name) for c in f.children])

        if at.idx:
            # Below the first level the elements are built by a lambda to keep the plan small.
            return F.transform(F.sequence(F.lit(0), size - 1), lambda i: element(i.cast("long")))
        # First level: all slots are plain expressions, which keeps them inside codegen.
        return F.slice(F.array(*[element(d.long(i)) for i in range(ARRAY_SLOTS)]), F.lit(1), size)

    def count_columns(self, row: Column) -> list[Column]:
        """Per row and counter: how the values of the row came about."""
        at = Address(d.long(row), (), d.long(row))
        return counters.columns(counters.together(self._events(f, "", at) for f in self.schema.root))

    def _events(self, f: Field, prefix: str, at: Address) -> counters.Events:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if f.is_leaf and f.kind != ARRAY:
            plan = self.leaf(f, path, len(at.idx))
            if path.lower() not in self.tied:
                return plan.compile(at).events
            if f.sample:
                return {MADE: F.lit(1), TIED: F.lit(1)}
            zero = tuple(d.long(0) for _ in at.idx)
            blank = plan.compile(Address(d.long(0), zero, d.long(0))).events.get(BLANK, F.lit(0))
            return {MADE: F.lit(1), BLANK: blank, TIED: F.lit(1) - blank}
        if f.kind != ARRAY:
            return counters.together(self._events(c, path, at) for c in f.children)
        size = self.array_size(path, at)
        return counters.together(
            counters.where(size > i, counters.together(self._events(c, path, self.element_address(at, d.long(i))) for c in f.children))
            for i in range(ARRAY_SLOTS))


def generate(spark: SparkSession, schema: Schema, n: int, seed: int, bank: Mapping[str, Sequence[str]] | None = None,
             order: str = "intent", pools: Pools | None = None) -> DataFrame:
    """``n`` records (at least one) of the schema; any partitioning gives the same rows."""
    n = max(int(n or 1), 1)
    return generate_for(spark.range(n), "id", schema, seed, bank=bank, order=order, pools=pools, bound=n)


def generate_for(rows: DataFrame, row_id: str, schema: Schema, seed: int, *, keep: Sequence[str] = (),
                 bank: Mapping[str, Sequence[str]] | None = None, order: str = "intent", pools: Pools | None = None,
                 bound: int | None = None, observed: Observation | None = None) -> DataFrame:
    """One record per row of ``rows``, addressed by its whole-number id; ``keep`` passes columns through.

    Unique leaves need distinct ids; an id beyond a leaf's capacity gets the exhaustion value.  ``bound``, above all ids where
    one is known, only saves work.  ``observed`` gets the counters of the run when the records are written.  ``rows`` may be a stream.
    """
    tune(rows.sparkSession)
    plan = SchemaPlan(schema, seed, bank, order, rows=bound, pools=pools)
    rows = drawn(rows, row_id, plan.wanted(F.col(row_id)), plan.pools.values, DRAWN)
    if observed is None:
        return rows.select(*keep, *plan.columns(F.col(row_id)))
    made = rows.select(F.struct(*plan.count_columns(F.col(row_id))).alias("__counts"), *keep, *plan.columns(F.col(row_id)))
    return made.observe(observed, *_sums("__counts.")).drop("__counts")


def _sums(prefix: str = "") -> list[Column]:
    return [F.coalesce(F.sum(f"{prefix}{c}"), F.lit(0)).alias(c) for c in counters.names()]


def generation_counts(rows: DataFrame, row_id: str, schema: Schema, seed: int, *, bank: Mapping[str, Sequence[str]] | None = None,
                      order: str = "intent", pools: Pools | None = None) -> DataFrame:
    """One row of run counters, summed map-side from the same draws as the records."""
    tune(rows.sparkSession)
    plan = SchemaPlan(schema, seed, bank, order, pools=pools)
    rows = drawn(rows, row_id, plan.wanted(F.col(row_id)), plan.pools.values, DRAWN)
    return rows.select(*plan.count_columns(F.col(row_id))).agg(*_sums())


def observed_counts(spark: SparkSession, observed: Observation) -> DataFrame:
    """The one-row report of a run that has been written."""
    found = observed.get
    return spark.range(1).select(*[F.lit(int(found[c])).cast("long").alias(c) for c in counters.names()])
