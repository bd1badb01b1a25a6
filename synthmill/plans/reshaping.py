"""Queries that reshape nested records built from the orders table, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from synthmill.functions.paths import document_path_exists, get_path, path_exists, set_path
from synthmill.functions.ranks import row_index
from synthmill.operators import reshape as R
from synthmill.plans.registry import query, table


def nested_orders(orders: DataFrame) -> DataFrame:
    """Records with an object, an array of objects and an array of scalars; no shuffle."""
    k = F.col("o_orderkey")

    def item(i: int):
        return F.struct(F.concat(F.lit("S"), (F.col("o_custkey") + i).cast("string")).alias("sku"),
                        ((k + i) % 7).alias("qty"))
    size = (k % 4).cast("int")
    return orders.select(
        k.alias("id"), F.col("o_orderstatus").alias("status"),
        F.struct(F.col("o_custkey").alias("id"), F.struct(F.col("o_orderpriority").alias("level")).alias("tier")).alias("customer"),
        F.slice(F.array(item(0), item(1), item(2)), F.lit(1), size).alias("items"),
        F.when(k % 5 > 0, F.slice(F.array("o_orderstatus", "o_orderpriority"), F.lit(1), (k % 3).cast("int"))).alias("tags"))


def nested(spark, sf_dir) -> DataFrame:
    return nested_orders(table(spark, sf_dir, "orders"))


def _item(i: int, field: str) -> str:
    value = f"'S' || (o_custkey + {i})" if field == "sku" else f"(o_orderkey + {i}) % 7"
    return f"CASE WHEN o_orderkey % 4 > {i} THEN {value} END"


_TAGS = "CASE WHEN o_orderkey % 5 > 0 THEN CASE o_orderkey % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[\"' || o_orderstatus || '\"]' ELSE '[\"' || o_orderstatus || '\",\"' || o_orderpriority || '\"]' END END"
_FLAT = ", ".join(f'{_item(i, f)} AS "items.{i}.{f}"' for i in range(3) for f in ("sku", "qty"))


@query("x1_flatten", 'SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS "customer.id", o_orderpriority AS "customer.tier.level" FROM orders')
def x1(spark, sf_dir):
    return R.flatten(nested(spark, sf_dir).select("id", "status", "customer"))


@query("x2_flatten_arrays", f"SELECT o_orderkey AS id, {_FLAT} FROM orders")
def x2(spark, sf_dir):
    return R.flatten(nested(spark, sf_dir).select("id", "items"))


@query("x2_flatten_slots", f'SELECT o_orderkey AS id, {_FLAT}, NULL::VARCHAR AS "items.3.sku", NULL::BIGINT AS "items.3.qty" FROM orders')
def x2_slots(spark, sf_dir):
    return R.flatten(nested(spark, sf_dir).select("id", "items"), slots=R.SCHEMA_SLOTS)


_CUSTOMER = """'{"id":' || o_custkey || ',"tier":{"level":"' || o_orderpriority || '"}}'"""
_ITEMS = "'[' || CASE WHEN o_orderkey % 4 > 0 THEN '{\"sku\":\"S' || o_custkey || '\",\"qty\":' || (o_orderkey % 7) || '}' ELSE '' END || " + " || ".join(
    f"CASE WHEN o_orderkey % 4 > {i} THEN ',{{\"sku\":\"S' || (o_custkey + {i}) || '\",\"qty\":' || ((o_orderkey + {i}) % 7) || '}}' ELSE '' END" for i in (1, 2)) + " || ']'"


@query("x3_nested_as_json", f"SELECT o_orderkey AS id, o_orderstatus AS status, {_CUSTOMER} AS customer, {_ITEMS} AS items, {_TAGS} AS tags FROM orders")
def x3(spark, sf_dir):
    return R.flatten(nested(spark, sf_dir), nested_as_json=True)


@query("x4_scalar_array_as_json", f"SELECT o_orderkey AS id, {_TAGS} AS tags FROM orders")
def x4(spark, sf_dir):
    return R.flatten(nested(spark, sf_dir).select("id", "tags"))


@query("x5_union_headers", """SELECT c_custkey::VARCHAR AS id, c_name AS name, '' AS brand, c_mktsegment AS grp FROM customer
UNION ALL SELECT p_partkey::VARCHAR, '', p_brand, p_type FROM part""")
def x5(spark, sf_dir):
    left = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS grp")
    right = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS brand", "p_type AS grp")
    return R.union_headers([left, right])


@query("x6_entity_split", """SELECT 'root' AS entity, o_orderkey AS parent, 0::BIGINT AS at, o_orderkey || '|' || o_orderstatus AS text FROM orders
UNION ALL SELECT 'customer.tier', o_orderkey, 0, o_orderpriority FROM orders
UNION ALL SELECT 'items', o_orderkey, i, 'S' || (o_custkey + i) || '|' || ((o_orderkey + i) % 7) FROM orders, range(3) t(i) WHERE i < o_orderkey % 4
UNION ALL SELECT 'tags', o_orderkey, i, CASE i WHEN 0 THEN o_orderstatus ELSE o_orderpriority END FROM orders, range(2) t(i) WHERE i < o_orderkey % 3 AND o_orderkey % 5 > 0
UNION ALL SELECT 'customer', o_orderkey, 0, o_custkey::VARCHAR FROM orders""")
def x6(spark, sf_dir):
    out = []
    for name, df in R.entity_split(nested(spark, sf_dir), "id").items():
        pos = [c for c in df.columns if c.endswith("_pos")]
        own = [c for c in df.columns if c not in (R.RECORD, *pos)]
        at = F.col(pos[0]).cast("long") if pos else F.lit(0).cast("long")
        text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in own])
        out.append(df.select(F.lit(name).alias("entity"), F.col(R.RECORD).alias("parent"), at.alias("at"), text.alias("text")))
    result = out[0]
    for p in out[1:]:
        result = result.unionByName(p)
    return result


@query("x7_entity_split_json", f"SELECT o_orderkey AS id, o_orderstatus AS status, {_CUSTOMER} AS customer, {_ITEMS} AS items, {_TAGS} AS tags FROM orders")
def x7(spark, sf_dir):
    return R.entity_split(nested(spark, sf_dir), "id", as_json=True)["root"].drop(R.RECORD)


@query("x8_per_key", """SELECT 'c_name' AS key, c_custkey, c_name AS value FROM customer UNION ALL SELECT 'c_nationkey', c_custkey, c_nationkey::VARCHAR FROM customer
UNION ALL SELECT 'c_mktsegment', c_custkey, c_mktsegment FROM customer""")
def x8(spark, sf_dir):
    return R.per_key(table(spark, sf_dir, "customer").drop("c_acctbal"), "c_custkey")


@query("x9_first_only", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1")
def x9(spark, sf_dir):
    return R.first_only(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), "o_orderkey")


@query("x10_split_n", """WITH i AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position, count(*) OVER () AS total FROM customer)
SELECT c_custkey, position, position // ceil(total / 7)::BIGINT AS batch FROM i""")
def x10(spark, sf_dir):
    part = table(spark, sf_dir, "customer").select("c_custkey")
    return R.split_n(row_index(part, "c_custkey", "position", chunk=1 << 8), "position", 7)


@query("x11_get_path", "SELECT o_orderkey AS id, o_orderpriority AS level, NULL::VARCHAR AS sku, NULL::VARCHAR AS none FROM orders")
def x11(spark, sf_dir):
    df = nested(spark, sf_dir)
    return df.select("id", get_path(df.schema, "customer.tier.level").alias("level"),
                     get_path(df.schema, "items.sku").alias("sku"), get_path(df.schema, "customer.none").alias("none"))


@query("x12_set_path", "SELECT o_orderkey AS id, o_custkey AS cid, 'L' || o_orderkey AS level, o_orderstatus AS made, o_orderpriority AS kept FROM orders")
def x12(spark, sf_dir):
    df = nested(spark, sf_dir).withColumn("kept", F.col("customer.tier.level"))
    for path, value in (("customer.tier.level", F.concat(F.lit("L"), F.col("id").cast("string"))), ("extra.deep.x", F.col("status"))):
        name, column = set_path(df.schema, path, value)
        df = df.withColumn(name, column)
    return df.select("id", F.col("customer.id").alias("cid"), "customer.tier.level", F.col("extra.deep.x").alias("made"), "kept")


@query("x13_path_exists", "SELECT event_id, true AS typed, event_id % 3 = 0 AS has_b, event_id % 3 = 0 AND event_id % 2 = 0 AS has_null FROM events")
def x13(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    e = F.col("event_id")
    doc = F.when(e % 3 == 0, F.when(e % 2 == 0, '{"a":{"b":null}}').otherwise('{"a":{"b":[1]}}')).otherwise('{"a":[{"b":1}]}')
    known = path_exists(events.schema, "props") and not path_exists(events.schema, "props.k")
    null = F.contains(doc, F.lit("null")) & document_path_exists(doc, "a.b")
    return events.select("event_id", F.lit(known).alias("typed"), document_path_exists(doc, "a.b").alias("has_b"), null.alias("has_null"))
