"""Queries for file naming, run reports and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from synthmill.functions import naming as N
from synthmill.operators import counters, naming as O, report as R
from synthmill.operators.generate import generation_counts
from synthmill.plans.duck import Leaf, TOKEN_TEXT, uuid_text
from synthmill.plans.generation import PRIORITIES, SEED
from synthmill.plans.registry import query, table
from synthmill.plans.reshaping import nested_orders
from synthmill.schema import ARRAY, Field, Schema

NOW_MS = 1_718_400_000_123


def records(spark, sf_dir) -> DataFrame:
    return nested_orders(table(spark, sf_dir, "orders"))


def context(df: DataFrame, fmt: str = "yaml", name: str = 'my:orders. ') -> N.NameContext:
    return N.NameContext(df.schema, name, fmt, 1000, SEED, NOW_MS)


def _named(spark, sf_dir, pattern: str, **options) -> DataFrame:
    df = records(spark, sf_dir)
    column = N.compile_name(N.Naming(pattern, prefix="p-", suffix="-s", **options), context(df), F.col("id"))
    return df.select("id", column.alias("path"))


_I = "(o_orderkey + 1)"


@query("n1_plain_tokens", f"""SELECT o_orderkey AS id, 'p-' || CASE WHEN length({_I}::VARCHAR) < 6 THEN lpad({_I}::VARCHAR, 6, '0') ELSE {_I}::VARCHAR END || '_'
 || CASE WHEN length({_I}::VARCHAR) < 4 THEN lpad({_I}::VARCHAR, 4, '0') ELSE {_I}::VARCHAR END || '_1000_myorders_yaml-s_{SEED}.yml' AS path FROM orders""")
def n1(spark, sf_dir):
    return _named(spark, sf_dir, "{prefix}{index:06}_{seq}_{count}_{schema}_{format}{suffix}_{seed}{unknown}.{ext}")


_MS = f"({NOW_MS} + o_orderkey)"
_DET = f"({N.EPOCH_MS} + {SEED % N.DAY_MS} + {_I} * 1000)"


@query("n2_clock_tokens", f"""SELECT o_orderkey AS id, strftime(epoch_ms({_MS}), '%Y-%m-%d') || '/' || {_MS} || '_' || strftime(epoch_ms({_MS}), '%H%M%S_%g') || '_'
 || strftime(epoch_ms({_MS}), '%Y%m%d_%H%M%S_%g') || '_' || strftime(epoch_ms({_MS}), '%y%m') || '.yml' AS path FROM orders""")
def n2(spark, sf_dir):
    return _named(spark, sf_dir, "{date:yyyy-MM-dd}/{ts}_{time}_{datetime}_{date:yyMM}")


@query("n2_clock_deterministic", f"SELECT o_orderkey AS id, strftime(epoch_ms({_DET}), '%Y%m%d_%H%M%S_%g') || '.yml' AS path FROM orders")
def n2_deterministic(spark, sf_dir):
    return _named(spark, sf_dir, "{date}", deterministic=True)


def _name_leaf(purpose: str, width: int) -> str:
    return Leaf(SEED, N.RANDOM_PATH, "o_orderkey").text(purpose, TOKEN_TEXT, width)


@query("n3_random_tokens", f"SELECT o_orderkey AS id, {uuid_text(Leaf(SEED, N.RANDOM_PATH, 'o_orderkey'), 'uuid0')} || '_' || {_name_leaf('rand2', 12)} || '_' || {_name_leaf('rand4', 8)} || '.yml' AS path FROM orders")
def n3(spark, sf_dir):
    return _named(spark, sf_dir, "{uuid}_{rand:12}_{rand}")


@query("n4_field_token", """SELECT o_orderkey AS id, o_orderstatus || '_' || o_orderpriority || '_' || '{level' || o_orderpriority || '}_.yml' AS path FROM orders""")
def n4(spark, sf_dir):
    df = records(spark, sf_dir)
    column = N.compile_name(N.Naming("{field:status}_{field:customer.tier.level}_{field:customer.tier}_{field:items.sku}"), context(df), F.col("id"))
    return df.select("id", F.regexp_replace(column, '[":]', "").alias("path"))


@query("n5_field_unique", f"""WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS v FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY lower(CASE WHEN v = '' THEN 'v' || {_I} ELSE v END) ORDER BY o_orderkey) AS n FROM f)
SELECT o_orderkey AS id, CASE WHEN n = 1 THEN CASE WHEN v = '' THEN 'v' || {_I} ELSE v END ELSE v || '_' || {_I} END AS fragment FROM r""")
def n5(spark, sf_dir):
    df = records(spark, sf_dir)
    blank = F.when(F.col("id") % 11 == 0, "").otherwise(F.col("customer.tier.level"))
    return O.unique_fragments(df.select("id", blank.alias("level")), "id", F.col("level"), "fragment").select("id", "fragment")


@query("n6_field_rand", f"SELECT o_orderkey AS id, o_orderstatus || '_' || {_name_leaf('rand0', 6)} || '-' || {_name_leaf('rand2', 6)} || '.yml' AS path FROM orders")
def n6(spark, sf_dir):
    return _named(spark, sf_dir, "{field:status|rand}-{field:none|rand}")


@query("n7_sanitise", """WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'CON' WHEN 1 THEN event_type || '<>. . ' WHEN 2 THEN '..' ELSE ' é' || event_type || '?' END AS a, props AS b FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '_CON' WHEN 1 THEN string_split(a, '<')[1] WHEN 2 THEN 'unnamed' ELSE '_' || rtrim(substr(a, 3), '?') END || '/'
 || replace(replace(b, '"', ''), ':', '') AS path FROM p""")
def n7(spark, sf_dir):
    e, kind = F.col("event_id") % 4, F.col("event_type")
    a = (F.when(e == 0, "CON").when(e == 1, F.concat(kind, F.lit("<>. . "))).when(e == 2, "..")
         .otherwise(F.concat(F.lit(" é"), kind, F.lit("?"))))
    path = F.concat_ws("\\", a, F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", N.clean_path(path, "ascii").alias("path"))


_PLAIN = "CASE WHEN o_orderkey % 3 = 0 THEN 'Hot.json' ELSE 'd/' || lower(o_orderpriority) || '.json' END"


def _plain_paths(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, F.when(k % 2 == 0, "Hot.json").otherwise("hot.JSON")).otherwise(
        F.concat(F.lit("d/"), F.lower("o_orderpriority"), F.lit(".json")))
    return orders.select(k.alias("id"), path.alias("path"))


_CASED = _PLAIN.replace("'Hot.json'", "CASE WHEN o_orderkey % 2 = 0 THEN 'Hot.json' ELSE 'hot.JSON' END")


@query("n8_collision_suffix", f"""WITH p AS (SELECT o_orderkey AS id, {_CASED} AS path FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY id) AS n FROM p)
SELECT id, CASE WHEN n = 1 THEN path ELSE path[:-6] || '_' || n || path[-5:] END AS path FROM r""")
def n8_suffix(spark, sf_dir):
    return O.resolve_collisions(_plain_paths(table(spark, sf_dir, "orders")), "id", "path")


@query("n8_collision_existing", f"""WITH p AS (SELECT o_orderkey AS id, {_CASED} AS path FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY id) AS g FROM p),
 x AS (SELECT *, CASE WHEN lower(path) = 'hot.json' THEN CASE WHEN g < 10 THEN g + 1 ELSE g + 25 END ELSE g END AS n FROM r)
SELECT id, CASE WHEN n = 1 THEN path ELSE path[:-6] || '_' || n || path[-5:] END AS path FROM x""")
def n8_existing(spark, sf_dir):
    # Files of an earlier run: the plain name and the numbers 11 to 34.
    taken = table(spark, sf_dir, "nation").select("n_nationkey").select(
        F.when(F.col("n_nationkey") == 0, "HOT.json").otherwise(
            F.concat(F.lit("Hot_"), (F.col("n_nationkey") + 10).cast("string"), F.lit(".json"))).alias("path"))
    return O.resolve_collisions(_plain_paths(table(spark, sf_dir, "orders")), "id", "path", "suffix", taken)


@query("n8_collision_skip", f"""WITH p AS (SELECT o_orderkey AS id, {_CASED} AS path FROM orders)
SELECT min(id) AS id, arg_min(path, id) AS path FROM p WHERE lower(path) <> 'd/5-low.json' GROUP BY lower(path)""")
def n8_skip(spark, sf_dir):
    taken = table(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select(F.lit("D/5-low.json").alias("path"))
    return O.resolve_collisions(_plain_paths(table(spark, sf_dir, "orders")), "id", "path", "skip", taken)


@query("n9_auto_extension", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'a.b/x' || o_orderkey || '.yml' ELSE 'a.b/x' || o_orderkey || '.Q1' END AS path FROM orders")
def n9(spark, sf_dir):
    df = records(spark, sf_dir).withColumn("leaf", F.concat(F.lit("x"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 1, ".Q1").otherwise("")))
    return df.select("id", N.compile_name(N.Naming("a.b/{field:leaf}"), context(df), F.col("id")).alias("path"))


# -- reports ------------------------------------------------------------------------------------
REPORTED = Schema("reported", [
    Field("priority", enum=PRIORITIES, null_rate=20), Field("day", sample="2024-06-15"),
    Field("qty", sample="100", min=95, max=110), Field("note", sample="Hi there 42", max_length=9),
    Field("code", sample="K 1", is_unique=True), Field("num", sample="1001", pattern="^[8-9].*[27]$"),
    Field("items", ARRAY, children=[Field("a", sample="x y"), Field("b", sample="5.5", null_rate=50)])])


def _l(path: str, *idx: str) -> Leaf:
    return Leaf(SEED, path, "o_orderkey", *idx)


_NUMS = "[" + ", ".join(f"({_l('num').below('number', 401, k)} + 801)" for k in range(24)) + "]"
_N = f"list_position(list_transform({_NUMS}, lambda c: regexp_matches(c::VARCHAR, '^[8-9].*[27]$')), true)"
_SIZE = f"(1 + {_l('items').below('size', 3)})"


def _sum_items(term) -> str:
    return "(" + " + ".join(f"CASE WHEN {_SIZE} > {i} THEN {term(str(i))} ELSE 0 END" for i in range(3)) + ")"


_COUNTS = f"""per AS (SELECT o_orderkey, {_SIZE} AS size, ({_l('priority').chance('null', .2)})::INT AS null1,
  {_sum_items(lambda i: f"({_l('items.b', i).chance('null', .5)})::INT")} AS null2,
  {_l('note').chance('source', .55, 0, 1)}::INT AS mutated, {_sum_items(lambda i: f"({_l('items.a', i).chance('source', .55, 0, 1)})::INT")} AS mutated2,
  {_l('qty').below('number', 41)} + 80 AS qty, {_N} AS hit FROM orders),
 counts AS (SELECT sum(6 + 2 * size)::BIGINT AS leaves_made, sum(null1 + null2)::BIGINT AS left_blank, sum(1 - null1)::BIGINT AS from_closed_set,
  0::BIGINT AS from_bank_literal, 0::BIGINT AS from_bank_joined, sum(mutated + mutated2)::BIGINT AS template_redrawn,
  sum(4 - mutated + (size - mutated2) + (size - null2))::BIGINT AS drawn_free, sum((o_orderkey < 260)::INT)::BIGINT AS drawn_distinct,
  sum((o_orderkey >= 260)::INT)::BIGINT AS distinct_used_up, 0::BIGINT AS tied, count(*) AS cut, 0::BIGINT AS padded,
  sum((qty < 95 OR qty > 110)::INT)::BIGINT AS clamped, sum(coalesce(hit - 1, 24))::BIGINT AS retried, sum((hit IS NULL)::INT)::BIGINT AS unmatched FROM per)"""


def counts_of_orders(spark, sf_dir) -> DataFrame:
    return generation_counts(table(spark, sf_dir, "orders"), "o_orderkey", REPORTED, SEED)


@query("m1_report", f"WITH {_COUNTS} SELECT * FROM counts")
def m1(spark, sf_dir):
    return counts_of_orders(spark, sf_dir)


@query("m2_report_rates", f"WITH {_COUNTS} SELECT 0.0::DOUBLE AS bank_percent, floor(left_blank * 1000.0::DOUBLE / leaves_made + 0.5) / 10 AS blank_percent FROM counts")
def m2(spark, sf_dir):
    return R.report_rates(counts_of_orders(spark, sf_dir)).select("bank_percent", "blank_percent")


@query("m3_build_manifest", f"""WITH {_COUNTS} SELECT '{{"app":"synthmill","version":"1.0.0","createdAt":"2024-06-15T00:00:00Z","seed":{SEED},"ciMode":true,"recordCount":' || (SELECT count(*) FROM orders) || ',"format":"csv","schemaName":"reported","schemaHash":"{REPORTED.hash()}","recordHistory":false,"report":{{'
 || {" || ',' || ".join(f"'\"{n}\":' || {n}" for n in counters.names())} || '}}}}' AS manifest FROM counts""")
def m3(spark, sf_dir):
    return R.build_manifest(counts_of_orders(spark, sf_dir), REPORTED, seed=SEED, record_count=table(spark, sf_dir, "orders").count(), ci_mode=True,
                            fmt="csv", created_at="2024-06-15T00:00:00Z")


def _manifest_texts(orders: DataFrame) -> DataFrame:
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 6
    good = F.concat(F.lit('{"seed":'), k.cast("string"), F.lit(',"recordCount":'), (k % 5).cast("string"),
                    F.lit(',"schemaHash":"h'), (k % 3).cast("string"), F.lit('","schemaName":"'), F.col("o_orderstatus"),
                    F.lit('","schemaId":"'), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("s"), (k % 2).cast("string"))),
                    F.lit('","ciMode":'), F.when(k % 7 == 0, "false").otherwise("true"), F.lit("}"))
    text = F.when(m == 0, "[1]").when(m == 1, '{"seed":"7","recordCount":5}').when(m == 2, '{"seed":7,"recordCount":5,"schemaHash":""}').otherwise(good)
    return orders.select(k, text.alias("content"))


_K = "o_orderkey"
_PARSED = f"""m AS (SELECT o_orderkey, o_orderstatus, CASE o_orderkey % 6 WHEN 0 THEN 'not a JSON object' WHEN 1 THEN 'no numeric seed' WHEN 2 THEN 'no schema hash'
  ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'no valid record count' END END AS problem FROM orders)"""


@query("m4_parse_manifest", f"""WITH {_PARSED} SELECT o_orderkey, problem, CASE WHEN problem IS NULL THEN o_orderkey END AS seed, CASE WHEN problem IS NULL THEN o_orderkey % 5 END AS record_count,
 CASE WHEN o_orderkey % 6 > 2 THEN 'h' || (o_orderkey % 3) WHEN o_orderkey % 6 = 2 THEN '' END AS schema_hash FROM m""")
def m4(spark, sf_dir):
    return R.parse_manifests(_manifest_texts(table(spark, sf_dir, "orders"))).select("o_orderkey", "problem", "seed", "record_count", "schema_hash")


@query("m5_compare_manifest", f"""WITH {_PARSED}, g AS (SELECT *, 'h' || (o_orderkey % 3) AS h, CASE WHEN o_orderkey % 4 > 0 THEN 's' || (o_orderkey % 2) END AS i FROM m WHERE problem IS NULL),
 c AS (SELECT *, o_orderstatus IN ('F', 'O') AS known FROM g),
 f AS (SELECT o_orderkey, known, coalesce(known AND h = 'h1', false) AS hash_match, CASE WHEN known AND i IS NOT NULL THEN i = 's0' END AS id_match,
   CASE WHEN known THEN true END AS name_match, o_orderkey % 7 = 0 AS live FROM c)
SELECT o_orderkey, hash_match, id_match, name_match, concat_ws('; ', CASE WHEN NOT known THEN 'no schema to compare with' END, CASE WHEN known AND NOT hash_match THEN 'schema structure differs' END,
  CASE WHEN NOT id_match THEN 'schema id differs' END, CASE WHEN known AND live THEN 'run used live bank values' END) AS warnings FROM f""")
def m5(spark, sf_dir):
    parsed = R.parse_manifests(_manifest_texts(table(spark, sf_dir, "orders"))).where("problem IS NULL")
    schemas = table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')").select("o_orderstatus").distinct().select(
        F.col("o_orderstatus").alias("schema_key"), F.lit("s0").alias("id"), F.col("o_orderstatus").alias("name"), F.lit("h1").alias("hash"))
    out = R.compare_manifests(parsed.withColumn("schema_key", F.col("schema_name")), schemas)
    return out.select("o_orderkey", "hash_match", "id_match", "name_match", F.array_join("warnings", "; ").alias("warnings"))
