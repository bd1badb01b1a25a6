"""Queries for record and leaf generation: synthetic rows that stand in for a table's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthmill.functions.draws import ALNUM, LOWER, UPPER
from synthmill.plans.banking import bank_from_events
from synthmill.operators.generate import generate, generate_for
from synthmill.operators.leaves import EMAIL_DOMAINS, YEAR_MS, epoch_ms
from synthmill.operators.pools import pools
from synthmill.plans import duck
from synthmill.plans.duck import Leaf, permuted
from synthmill.plans.registry import query, table
from synthmill.schema import ARRAY, OBJECT, Field, Schema

SEED = 20240615
START = epoch_ms(SEED) - 3 * YEAR_MS
SPAN = 4 * YEAR_MS
KEY = "o_orderkey"


def _leaf(path: str = "v", row: str = KEY, *idx: str) -> Leaf:
    return Leaf(SEED, path, row, *idx)


def leaf_query(name: str, field: Field, sql: str) -> None:
    """One leaf generated for every order."""

    @query(name, f"SELECT o_orderkey, {sql} AS v FROM orders")
    def run(spark, sf_dir):
        return generate_for(table(spark, sf_dir, "orders"), KEY, Schema("leaf", [field]), SEED, keep=[KEY])


v = _leaf()


def _number(low: int, high: int, leaf: Leaf = v) -> str:
    return f"({leaf.below('number', high - low + 1)} + {low})"


def _date(kind: str) -> str:
    return duck.date_text(f"({START} + {v.below('date', SPAN)})", kind)


def _mutated(template: str, leaf: Leaf = v, k: int = 0) -> str:
    """Plain text leaf: outer mutation, else the synthesiser, which mutates again."""
    return f"CASE WHEN {leaf.chance('source', .55, k, 1)} THEN {leaf.fill('mutate', template, k)} ELSE {leaf.fill('synth', template, k)} END"


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

leaf_query("l1_null_rate", Field("v", enum=PRIORITIES, null_rate=25),
           f"CASE WHEN {v.chance('null', .25)} THEN NULL ELSE {v.pick('enum', PRIORITIES)} END")
leaf_query("l2_enum", Field("v", enum=PRIORITIES), v.pick("enum", PRIORITIES))
leaf_query("l3_enum_unique", Field("v", enum=[f"code-{i}" for i in range(40)], is_unique=True),
           f"'code-' || CASE WHEN o_orderkey < 40 THEN {permuted(KEY, 40, SEED, 'v')} ELSE {v.below('enum', 40)} END")

leaf_query("l5_mutate", Field("v", sample="Acme Corp 12"), _mutated("Acme Corp 12"))
leaf_query("l6_bool", Field("v", sample="true"), v.chance("bool", .5))
leaf_query("l7_int", Field("v", sample="1001"), _number(801, 1201))
leaf_query("l8_int_padded", Field("v", sample="00042"), f"lpad({_number(32, 52)}::VARCHAR, 5, '0')")
leaf_query("l9_float", Field("v", sample="19.99"), f"{_number(999, 2999)} / 100.0::DOUBLE")


def _money(units: str) -> str:
    return duck.let(units, lambda u: f"('$' || format('{{:,}}', {u} // 100) || '.' || lpad(({u} % 100)::VARCHAR, 2, '0'))")


leaf_query("l10_currency", Field("v", sample="$1,200.00"), _money(_number(96000, 144000)))
leaf_query("l11_percent", Field("v", sample="45.5%"), duck.let(
    _number(355, 555), lambda u: f"({u} // 10 || '.' || {u} % 10 || '%')"))
leaf_query("l12_date_iso", Field("v", sample="2024-06-15"), _date("date-iso"))
leaf_query("l13_datetime_iso", Field("v", sample="2024-06-15T10:00:00Z"), _date("datetime-iso"))
leaf_query("l14_date_us", Field("v", sample="06/15/2024"), _date("date-us"))
leaf_query("l15_date_eu", Field("v", sample="15/06/2024"), _date("date-eu"))
leaf_query("l16_date_slash_ymd", Field("v", sample="2024/06/15"), _date("date-slash-ymd"))

_MAIL = "jo.lee7@example.com"
_FRESH = (f"(substr({v.text('text', LOWER, 10)}, 1, 5 + {v.below('text-length', 6)}) || (1 + {v.below('email-number', 999)})"
          f" || '@' || {v.pick('email-domain', list(EMAIL_DOMAINS))})")
leaf_query("l17_email", Field("v", sample=_MAIL),
           f"CASE WHEN {v.chance('source', .55, 0, 1)} THEN {v.fill('mutate', _MAIL)}"
           f" WHEN {v.chance('synth-source', .4)} THEN {v.fill('synth', _MAIL)} ELSE {_FRESH} END")
_HEX = [f"lower(lpad(to_hex(({v.raw('uuid', 0, p)})::UBIGINT), 16, '0'))" for p in (0, 1)]
_UUID = "89375b00-0000-4000-8000-00000000abcd"
leaf_query("l18_uuid", Field("v", sample=_UUID),
           f"CASE WHEN {v.chance('source', .55, 0, 1)} THEN {v.fill('mutate', _UUID)} ELSE "
           + duck.let(f"[{_HEX[0]}, {_HEX[1]}]", lambda h: (
               f"({h}[1][1:8] || '-' || {h}[1][9:12] || '-4' || {h}[1][13:15] || '-' || {h}[2][1:4] || '-' || {h}[2][5:16])")) + " END")
leaf_query("l19_phone", Field("v", sample="(555) 010-1234"), _mutated("(555) 010-1234"))


def _letters(template: str, share: float, alphabet: str, width: int) -> str:
    return (f"CASE WHEN {v.chance('source', .55, 0, 1)} THEN {v.fill('mutate', template)}"
            f" WHEN {v.chance('synth-source', share)} THEN {v.fill('synth', template)} ELSE {v.text('text', alphabet, width)} END")


leaf_query("l20_alpha", Field("v", sample="Seattle"), _letters("Seattle", .55, UPPER, 7))
leaf_query("l21_alnum", Field("v", sample="INV-2024-001"), _letters("INV-2024-001", .6, ALNUM, 12))
leaf_query("l22_string", Field("v"),
           f"substr({v.text('text', LOWER, 12)}, 1, 4 + {v.below('text-length', 9)})")


# Unique leaves: the ordinal is permuted and written in the digits of the template.
def _unique_code(ordinal: str, path: str) -> str:
    size = 26 ** 3 * 10 ** 5
    return duck.let(permuted(ordinal, size, SEED, path), lambda c: (
        f"({duck.spell(f'({c} % {26 ** 3})', UPPER, 3)} || '-' || {duck.spell(f'({c} // {26 ** 3})', duck.DIGITS, 5)})"))


leaf_query("l23_unique", Field("v", sample="ORD-10042", is_unique=True), _unique_code(KEY, "v"))
_WIDE = 26 ** 3 * 10 ** 12


@query("l23_unique_wide", f"""SELECT o_orderkey, {duck.let(duck.permuted_wide(KEY, _WIDE, SEED, "v"), lambda c: (
    f"({duck.spell(f'({c} % {26 ** 3})', UPPER, 3)} || {duck.spell(f'({c} // {26 ** 3})', duck.DIGITS, 12)})"))} AS v FROM orders""")
def unique_wide(spark, sf_dir):
    return generate_for(table(spark, sf_dir, "orders"), KEY,
                        Schema("leaf", [Field("v", sample="REF000000000001", is_unique=True)]), SEED, keep=[KEY])


_BILLION = 400_000_001  # values around the sample 1000000000
_UNIQUE_TRIES = "[" + ", ".join(f"({permuted(f'(o_orderkey * 24 + {k})', _BILLION, SEED, 'v')} + 800000000)" for k in range(24)) + "]"
leaf_query("l23_unique_pattern", Field("v", sample="1000000000", is_unique=True, pattern="[37]$"), duck.let(
    _UNIQUE_TRIES, lambda t: f"coalesce(list_filter({t}, lambda c: regexp_matches(c::VARCHAR, '[37]$'))[1], {t}[24])"))


@query("l23_unique_pooled", f"""SELECT o_orderkey, {permuted('(o_orderkey * 2)', _BILLION, SEED, 'key:pool:codes')} + 800000000 AS a,
  {permuted('(o_orderkey * 2 + 1)', _BILLION, SEED, 'key:pool:codes')} + 800000000 AS b FROM orders""")
def unique_pooled(spark, sf_dir):
    pooled = [Field(name, sample="1000000000", is_unique=True, pool="codes") for name in "ab"]
    return generate_for(table(spark, sf_dir, "orders"), KEY, Schema("pooled", pooled), SEED, keep=[KEY])


_SHAPES = ["Ab " + "1" * i for i in range(1, 14)] + ["no digits: " + "x" * 15 + " é"]


def _of_shapes(purpose: str) -> str:
    return f"CASE {v.below(f'{purpose}-pick', len(_SHAPES))} " + " ".join(
        f"WHEN {i} THEN {v.fill(purpose, s)}" for i, s in enumerate(_SHAPES)) + " END"


@query("l5_mutate_many_shapes", f"""SELECT o_orderkey, CASE WHEN {v.chance('source', .5)} THEN {v.pick('bank', _SHAPES)}
   WHEN {v.chance('source', .55, 0, 1)} THEN {_of_shapes('mutate')} ELSE {_of_shapes('synth')} END AS v FROM orders""")
def many_shapes(spark, sf_dir):
    return generate_for(table(spark, sf_dir, "orders"), KEY, Schema("leaf", [Field("v")]), SEED, keep=[KEY], bank={"v": _SHAPES})


_SPENT = f"({v.word('spent', LOWER, 6)} || '_' || ({v.below('spent', 999_000, 0, 1)} + 1000))"
leaf_query("l24_exhaustion_fallback", Field("v", sample="K 1", is_unique=True),
           "CASE WHEN o_orderkey < 260 THEN " + duck.let(permuted(KEY, 260, SEED, "v"), lambda c: (
               f"({duck.spell(f'({c} % 26)', UPPER, 1)} || ' ' || {duck.spell(f'({c} // 26)', duck.DIGITS, 1)})")) + f" ELSE {_SPENT} END")
leaf_query("l25_length_repair", Field("v", sample="Hi there 42", min_length=8, max_length=9),
           f"substr({_mutated('Hi there 42')}, 1, 9)")
leaf_query("l25_length_pad", Field("v", sample="Hi 4", min_length=8), f"({_mutated('Hi 4')}) || 'xxxx'")
leaf_query("l26_range_repair", Field("v", sample="100", min=95, max=110),
           f"greatest(95, least(110, {_number(80, 120)}))")
leaf_query("l26_currency_clamp", Field("v", sample="$1,200.00", min=1000, max=1300.5),
           _money(f"greatest(100000, least(130050, {_number(96000, 144000)}))"))
_TRIES = "[" + ", ".join(f"({v.below('number', 401, k)} + 801)" for k in range(24)) + "]"
leaf_query("l27_regex_retry", Field("v", sample="1001", pattern="^[8-9].*[27]$"),
           duck.let(_TRIES, lambda t: f"coalesce(list_filter({t}, lambda c: regexp_matches(c::VARCHAR, '^[8-9].*[27]$'))[1], {t}[24])"))
leaf_query("l28_coerce_output", Field("v", sample="7", min=1, max=9),
           f"greatest(1, least(9, {_number(-3, 17)}))")

# -- a leaf that draws from the bank ------------------------------------------------------
_PICKED = Field("v", source_keys=["click"])


@query("l4_from_bank", f"""
WITH bank AS (SELECT 'u' || lpad(user_id::VARCHAR, 6, '0') AS value, count(*) AS uses, max(ts) AS last
              FROM events WHERE event_type = 'click' GROUP BY 1),
     pool AS (SELECT list(value ORDER BY uses DESC, last DESC, value) AS vals FROM
              bank)
SELECT o_orderkey, CASE WHEN {v.chance('source', .5)} THEN {v.pick('bank', 'vals')}
   WHEN {v.chance('source', .55, 0, 1)} THEN {v.fill('mutate', 'u000000')}
   WHEN {v.chance('synth-source', .6)} THEN {v.fill('synth', 'u000000')}
   ELSE {v.text('text', ALNUM, 7)} END AS v
FROM orders, pool""")
def from_bank(spark, sf_dir):
    bank = bank_from_events(table(spark, sf_dir, "events"))
    schema = Schema("leaf", [_PICKED])
    return generate_for(table(spark, sf_dir, "orders"), KEY, schema, SEED, keep=[KEY],
                        pools=pools(bank, schema))


# -- records --------------------------------------------------------------------------------
CUSTOMER = Schema("customer", [
    Field("customer_id", sample="10001", is_primary=True, min=0, max=4_000_000),
    Field("full_name", sample="Robin Vale"), Field("email", sample=_MAIL),
    Field("signup_date", sample="2024-06-15"), Field("balance", sample="19.99")])


def _customer(path: str) -> Leaf:
    return Leaf(SEED, path, "c_custkey")


_C = {p: _customer(p) for p in ("full_name", "email", "signup_date", "balance")}
_CE = _C["email"]


@query("g1_generate", f"""SELECT
  CASE WHEN c_custkey < 4001 THEN {permuted('c_custkey', 4001, SEED, 'customer_id')} + 8001
       ELSE greatest(0, least(4000000, {epoch_ms(SEED)}::BIGINT + {_customer('customer_id').below('spent', 10 ** 9)}) % 1000000000) END AS customer_id,
  {_mutated('Robin Vale', _C['full_name'])} AS full_name,
  CASE WHEN {_CE.chance('source', .55, 0, 1)} THEN {_CE.fill('mutate', _MAIL)}
       WHEN {_CE.chance('synth-source', .4)} THEN {_CE.fill('synth', _MAIL)}
       ELSE substr({_CE.text('text', LOWER, 10)}, 1, 5 + {_CE.below('text-length', 6)}) || (1 + {_CE.below('email-number', 999)})
            || '@' || {_CE.pick('email-domain', list(EMAIL_DOMAINS))} END AS email,
  {duck.date_text(f"({START} + {_C['signup_date'].below('date', SPAN)})", 'date-iso')} AS signup_date,
  ({_C['balance'].below('number', 2001)} + 999) / 100.0::DOUBLE AS balance
FROM customer""")
def g1(spark, sf_dir):
    # As many records as there are customers, whose keys are the row ids from 0 on.
    return generate(spark, CUSTOMER, table(spark, sf_dir, "customer").count(), SEED)


@query("g2_draw", f"SELECT event_id, {Leaf(SEED, 'g2', 'event_id').draw('draw', 3, 1)} AS bits FROM events")
def g2(spark, sf_dir):
    from synthmill.functions.draws import draw, draw_key
    return table(spark, sf_dir, "events").select(
        "event_id", draw(draw_key(SEED, "g2", "draw"), F.col("event_id"), 3, 1).alias("bits"))


NESTED = Schema("order", [
    Field("customer", OBJECT, children=[
        Field("id", sample="C 88010000", is_unique=True), Field("name", sample="Acme Corp")]),
    Field("items", ARRAY, children=[Field("sku", sample="SKU 100000", is_unique=True), Field("qty", sample="2", min=1)]),
    Field("codes", ARRAY, children=[Field("item", sample="7.5")])])


@query("g3_object", f"""SELECT o_orderkey,
  {duck.let(duck.permuted_wide(KEY, 26 * 10 ** 8, SEED, 'customer.id'), lambda c: f"({duck.spell(f'({c} % 26)', UPPER, 1)} || ' ' || {duck.spell(f'({c} // 26)', duck.DIGITS, 8)})")} AS id,
  {_mutated('Acme Corp', _leaf('customer.name'))} AS name FROM orders""")
def g3(spark, sf_dir):
    return generate_for(table(spark, sf_dir, "orders"), KEY, NESTED, SEED, keep=[KEY]).select(KEY, "customer.*")


_SKU = 26 ** 3 * 10 ** 6


@query("g4_array", f"""WITH r AS (SELECT o_orderkey, unnest(range(0, 1 + {_leaf('items').below('size', 3)})) AS pos FROM orders)
SELECT o_orderkey, pos, {duck.let(duck.permuted_wide('o_orderkey * 3 + pos', _SKU, SEED, 'items.sku'), lambda c: f"({duck.spell(f'({c} % {26 ** 3})', UPPER, 3)} || ' ' || {duck.spell(f'({c} // {26 ** 3})', duck.DIGITS, 6)})")} AS sku,
  greatest(1, {_leaf('items.qty', KEY, 'pos').below('number', 21)} - 8) AS qty FROM r""")
def g4(spark, sf_dir):
    made = generate_for(table(spark, sf_dir, "orders"), KEY, NESTED, SEED, keep=[KEY])
    return made.select(KEY, F.posexplode("items").alias("pos", "item")).select(
        KEY, F.col("pos").cast("long").alias("pos"), "item.*")


@query("g4_scalar_array", f"""WITH r AS (SELECT o_orderkey, unnest(range(0, 1 + {_leaf('codes').below('size', 3)})) AS pos FROM orders)
SELECT o_orderkey, pos, ({_leaf('codes.item', KEY, 'pos').below('number', 201)} - 25) / 10.0::DOUBLE AS code FROM r""")
def g4_scalars(spark, sf_dir):
    made = generate_for(table(spark, sf_dir, "orders"), KEY, NESTED, SEED, keep=[KEY])
    return made.select(KEY, F.posexplode("codes").alias("pos", "code")).select(
        KEY, F.col("pos").cast("long").alias("pos"), "code")


TIED = Schema("tied", [Field("case_id", sample="89375b"), Field("event", sample="892"),
                       Field("owner", OBJECT, children=[Field("name"), Field("team", sample="true")]),
                       Field("amount", sample="12.5")],
              tied_paths=["case_id", "event", "owner.team"])


@query("g5_tie", f"SELECT o_orderkey, '89375b' AS case_id, 892 AS event, true AS team, ({_leaf('amount').below('number', 201)} + 25) / 10.0::DOUBLE AS amount FROM orders")
def g5(spark, sf_dir):
    made = generate_for(table(spark, sf_dir, "orders"), KEY, TIED, SEED, keep=[KEY])
    return made.select(KEY, "case_id", "event", "owner.team", "amount")


@query("g6_tie_first", f"SELECT o_orderkey, substr({Leaf(SEED, 'owner.name', '0').text('text', LOWER, 12)}, 1, 4 + {Leaf(SEED, 'owner.name', '0').below('text-length', 9)}) AS name FROM orders")
def g6(spark, sf_dir):
    schema = Schema("tied", TIED.root, tied_paths=["owner.name"])
    return generate_for(table(spark, sf_dir, "orders"), KEY, schema, SEED, keep=[KEY]).select(KEY, "owner.name")


MODES = {"case_id": "unique", "event": "same"}


@query("g7_field_modes", f"""SELECT o_orderkey,
  {duck.let(duck.permuted_wide(KEY, 62 ** 6, SEED, 'case_id'), lambda c: duck.spell(c, ALNUM, 6))} AS case_id,
  892 AS event, ({_leaf('amount').below('number', 201)} + 25) / 10.0::DOUBLE AS amount FROM orders""")
def g7(spark, sf_dir):
    schema = Schema("tied", TIED.root).with_modes(MODES)
    return generate_for(table(spark, sf_dir, "orders"), KEY, schema, SEED, keep=[KEY]).select(
        KEY, "case_id", "event", "amount")
