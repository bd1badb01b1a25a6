"""Learn from a table, then generate its synthetic twin."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from synthmill.functions.draws import UPPER
from synthmill.operators import bank as B, infer as I
from synthmill.operators.generate import generate_for
from synthmill.operators.harvest import learned_rows
from synthmill.operators.pools import pools
from synthmill.plans.duck import Leaf
from synthmill.plans.registry import query, table
from synthmill.schema import Schema

_BANK_DDL = ("id string, category_id string, key_name string, value string, use_count bigint,"
             " last_used_at timestamp_ntz, created_at timestamp_ntz")


def learn(df: DataFrame, row: str, name: str, bank: DataFrame | None = None,
          now: datetime | None = None, cap: int | None = None) -> tuple[Schema, DataFrame]:
    """(schema, bank) of a typed frame: its shape with first samples, and its values (of each path, or its first ``cap``) added to the bank."""
    rows = I.leaves(df, row)
    schema = I.to_schema(I.schema_rows(rows), name)
    start = bank if bank is not None else df.sparkSession.createDataFrame([], _BANK_DDL)
    at = F.current_timestamp() if now is None else F.lit(now.isoformat(sep=" "))
    return schema, B.record_ensure(start, learned_rows(I.harvest_values(rows, cap=cap)), at.cast("timestamp_ntz"))


def twin(df: DataFrame, row: str, name: str, seed: int) -> DataFrame:
    """As many generated records as the frame has rows, in the formats and from all the values it shows."""
    schema, bank = learn(df, row, name)
    return generate_for(df, row, schema, seed, keep=[row], pools=pools(bank, schema))


_ROW, _SEED = "c_custkey", 42
_NAME, _NATION, _BALANCE, _SEGMENT = (Leaf(_SEED, path, _ROW) for path in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


def _pool(column: str, text: str) -> str:
    """The values of a column that the plan carries, in the order of the bank."""
    return f"(SELECT list(t ORDER BY t) FROM (SELECT DISTINCT {text} AS t FROM customer WHERE {column} IS NOT NULL))"


def _number(leaf: Leaf, pool: str, least: int) -> str:
    """A number of the pool, or one from its range widened by a tenth below and a quarter above; in units."""
    span = f"greatest(list_max({pool}) - list_min({pool}), {least})"
    low = f"ceil((10 * list_min({pool}) - {span}) / 10.0)::BIGINT"
    high = f"floor((4 * list_max({pool}) + {span}) / 4.0)::BIGINT"
    return f"CASE WHEN {leaf.chance('source', .5)} THEN {leaf.pick('bank', pool)} ELSE {leaf.below('number', f'{high} - {low} + 1')} + {low} END"


def _segment(purpose: str) -> str:
    """A segment's letters redrawn: the first row's segment comes first in the pool, then the others in order."""
    sizes = " ".join(f"WHEN {n} THEN {_SEGMENT.word(purpose, UPPER, n)}" for n in range(1, 13))
    return f"CASE len(segments[1 + {_SEGMENT.below(f'{purpose}-pick', 'len(segments)')}]) {sizes} END"


_TEMPLATE = "Customer#000000000"


@query("learn_and_generate", f"""WITH pools AS (SELECT {_pool('c_name', 'c_name')} AS names,
   list_transform({_pool('c_nationkey', 'c_nationkey::VARCHAR')}, lambda t: t::BIGINT) AS nations,
   list_transform({_pool('c_acctbal', "regexp_replace(c_acctbal::VARCHAR, '[.]0$', '')")}, lambda t: (t::DECIMAL(18, 2) * 100)::BIGINT) AS balances,
   {_pool('c_mktsegment', 'c_mktsegment')} AS known, (SELECT arg_min(c_mktsegment, c_custkey) FROM customer) AS head),
 p AS (SELECT *, list_prepend(head, list_filter(known, lambda t: t <> head)) AS segments,
   list_min(list_transform(known, lambda t: len(t))) AS shortest, list_max(list_transform(known, lambda t: len(t))) AS longest FROM pools)
SELECT c_custkey,
  CASE WHEN {_NAME.chance('source', .5)} THEN {_NAME.pick('bank', 'names')} WHEN {_NAME.chance('source', .55, 0, 1)}
    THEN {_NAME.fill('mutate', _TEMPLATE)} ELSE {_NAME.fill('synth', _TEMPLATE)} END AS c_name,
  ({_number(_NATION, 'nations', 1)})::BIGINT AS c_nationkey, ({_number(_BALANCE, 'balances', 100)}) / 100.0::DOUBLE AS c_acctbal,
  CASE WHEN {_SEGMENT.chance('source', .5)} THEN {_SEGMENT.pick('bank', 'known')} WHEN {_SEGMENT.chance('source', .55, 0, 1)} THEN {_segment('mutate')}
    WHEN {_SEGMENT.chance('synth-source', .55)} THEN {_segment('synth')}
    ELSE substr({_SEGMENT.text('text', UPPER, 10)}, 1, shortest + {_SEGMENT.below('text-length', 'longest - shortest + 1')}) END AS c_mktsegment
FROM customer, p""")
def learn_and_generate(spark, sf_dir):
    return twin(table(spark, sf_dir, "customer"), _ROW, "customer", _SEED)
