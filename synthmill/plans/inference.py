"""Queries that infer shapes, values and format kinds from the tables and from JSON built of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from synthmill.functions import kinds as K
from synthmill.functions.paths import read_keys, write_key
from synthmill.operators import infer as I
from synthmill.operators.hashing import schema_hash
from synthmill.operators.harvest import harvest_run
from synthmill.plans.generation import SEED, TIED
from synthmill.plans.duck import Leaf
from synthmill.operators.generate import generate_for
from synthmill.plans.registry import query, table
from synthmill.schema import Schema


def event_documents(events: DataFrame) -> DataFrame:
    """JSON records with optional, nested and repeated fields."""
    e, kind = F.col("event_id"), F.col("event_type")
    tags = F.when(e % 3 == 0, F.concat(F.lit(',"tags":["'), kind, F.lit('","t'), (e % 5).cast("string"), F.lit('"]')))
    items = F.when(e % 4 == 1, F.concat(F.lit(',"items":[{"sku":"S'), (F.col("user_id") % 50).cast("string"),
                                        F.lit('","qty":'), (e % 9).cast("string"), F.lit("},{}]")))
    note = F.when(e % 2 == 0, F.lit(',"note":" "')).when(e % 5 == 0, F.concat(F.lit(',"note":"n'), (e % 100).cast("string"), F.lit('"')))
    doc = F.concat(F.lit('{"user_id":'), F.col("user_id").cast("string"), F.lit(',"props":'), F.col("props"),
                   F.coalesce(tags, F.lit("")), F.coalesce(items, F.lit("")), F.coalesce(note, F.lit("")), F.lit("}"))
    return events.select("event_id", "event_type", doc.alias("document"))


def _leaves(spark, sf_dir, by=()):
    return I.document_leaves(event_documents(table(spark, sf_dir, "events")), "document", "event_id", by)


# Leaf rows of those documents: one entry per leaf, in the order of the sorted keys.
_DOC_LEAVES = """leaf AS (
  SELECT event_id, event_type, 0 AS a, 0 AS b, 'items.sku' AS path, 'S' || (user_id % 50) AS value FROM events WHERE event_id % 4 = 1
  UNION ALL SELECT event_id, event_type, 0, 1, 'items.qty', (event_id % 9)::VARCHAR FROM events WHERE event_id % 4 = 1
  UNION ALL SELECT event_id, event_type, 1, 0, 'note', CASE WHEN event_id % 2 = 0 THEN ' ' ELSE 'n' || (event_id % 100) END FROM events WHERE event_id % 2 = 0 OR event_id % 5 = 0
  UNION ALL SELECT event_id, event_type, 2, 0, 'props.k', json_extract_string(props, '$.k') FROM events
  UNION ALL SELECT event_id, event_type, 3, 0, 'tags.item', event_type FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, event_type, 3, 1, 'tags.item', 't' || (event_id % 5) FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, event_type, 4, 0, 'user_id', user_id::VARCHAR FROM events)"""


@query("i1_normalize", "SELECT o_orderkey, 0 AS at, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 1, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1")
def i1(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    tags = F.slice(F.array("o_orderstatus", "o_orderpriority"), F.lit(1), (1 + F.col("o_orderkey") % 2).cast("int"))
    return I.normalize(orders.select("o_orderkey", tags.alias("tags")), "tags", "o_orderkey")


@query("i2_leaf_paths", f"WITH {_DOC_LEAVES} SELECT DISTINCT event_type, path FROM leaf")
def i2(spark, sf_dir):
    return I.leaf_paths(_leaves(spark, sf_dir, ["event_type"]), ["event_type"])


def _harvest_sql(cap: int) -> str:
    return f"""first AS (SELECT path, trim(value) AS value, min({{'e': event_id, 'a': a, 'b': b}}) AS seen FROM leaf WHERE trim(value) <> '' GROUP BY ALL),
 ranked AS (SELECT path, value, row_number() OVER (PARTITION BY path ORDER BY seen, value) AS rank FROM first)
SELECT path, value, rank FROM ranked WHERE rank <= {cap}"""


def _rank_long(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


@query("i3_harvest_documents", f"WITH {_DOC_LEAVES}, {_harvest_sql(200)}")
def i3_documents(spark, sf_dir):
    return _rank_long(I.harvest_values(_leaves(spark, sf_dir), cap=200))


@query("i3_harvest_values", f"""WITH leaf AS (
  SELECT c_custkey AS event_id, 0 AS a, 0 AS b, 'c_name' AS path, c_name AS value FROM customer
  UNION ALL SELECT c_custkey, 1, 0, 'c_nationkey', c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT c_custkey, 2, 0, 'c_acctbal', regexp_replace(c_acctbal::VARCHAR, '\\.0$', '') FROM customer
  UNION ALL SELECT c_custkey, 3, 0, 'c_mktsegment', c_mktsegment FROM customer), {_harvest_sql(200)}""")
def i3(spark, sf_dir):
    return _rank_long(I.harvest_values(I.leaves(table(spark, sf_dir, "customer"), "c_custkey"), cap=200))


@query("i4_merge_shapes", f"""WITH {_DOC_LEAVES},
 m AS (SELECT path, arg_min(value, {{'e': event_id, 'a': a, 'b': b}}) FILTER (trim(value, chr(31)) <> '') AS sample, min(event_id) FILTER (value <> '') AS first_pos FROM leaf GROUP BY path)
SELECT path, 'value' AS kind, sample, first_pos FROM m UNION ALL SELECT 'items.item', 'object', NULL, min(event_id) FROM events WHERE event_id % 4 = 1""")
def i4(spark, sf_dir):
    return I.merge_shapes(_leaves(spark, sf_dir)).select("path", "kind", "sample", "first_pos")


_TREE = """tree AS (
  SELECT event_type, path, arg_min(value, {'e': event_id, 'a': a, 'b': b}) AS sample, 'value' AS kind FROM leaf GROUP BY event_type, path
  UNION ALL SELECT DISTINCT event_type, 'items', NULL, 'array' FROM leaf WHERE path = 'items.sku'
  UNION ALL SELECT DISTINCT event_type, 'items.item', NULL, 'object' FROM leaf WHERE path = 'items.sku'
  UNION ALL SELECT DISTINCT event_type, 'tags', NULL, 'array' FROM leaf WHERE path = 'tags.item'
  UNION ALL SELECT DISTINCT event_type, 'props', NULL, 'object' FROM leaf WHERE path = 'props.k'),
 flags AS (SELECT *, string_split(path, '.')[-1] AS name, array_to_string(string_split(path, '.')[:-2], '.') AS parent FROM tree)"""


@query("i5_infer_kinds", f"WITH {_DOC_LEAVES}, {_TREE} SELECT event_type, path, name, parent, kind FROM flags")
def i5(spark, sf_dir):
    return I.schema_rows(_leaves(spark, sf_dir, ["event_type"]), ["event_type"]).select("event_type", "path", "name", "parent", "kind")


@query("i6_flag_keys", """WITH n AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ID' WHEN 1 THEN '_id' WHEN 2 THEN event_type || '_Id' WHEN 3 THEN 'uuid' WHEN 4 THEN 'idx' ELSE 'guid' END AS name FROM events)
SELECT event_id, lower(name) IN ('id', '_id', 'uuid', 'guid') OR ends_with(lower(name), '_id') AS is_primary, lower(name) IN ('id', '_id', 'uuid', 'guid') AS is_unique FROM n""")
def i6(spark, sf_dir):
    e = F.col("event_id") % 6
    name = (F.when(e == 0, "ID").when(e == 1, "_id").when(e == 2, F.concat("event_type", F.lit("_Id")))
            .when(e == 3, "uuid").when(e == 4, "idx").otherwise("guid"))
    primary, unique = I.flag_keys(name)
    return table(spark, sf_dir, "events").select("event_id", primary.alias("is_primary"), unique.alias("is_unique"))


# -- format kinds -----------------------------------------------------------------------------
def formatted_values(orders: DataFrame) -> DataFrame:
    """The same facts written in many formats, as (path, value, pos)."""
    k, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, rest = F.call_function("div", cents, F.lit(100)), F.lpad((cents % 100).cast("string"), 2, "0")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    year, month, day = F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)
    hexed = F.md5(k.cast("string"))
    forms = {
        "flag": F.when(k % 2 == 0, "true").otherwise("FALSE"), "day": iso, "moment": F.concat(iso, F.lit("T08:00:00Z")),
        "day_us": F.concat_ws("/", month, day, year), "day_eu": F.concat_ws("/", day, month, year),
        "day_ymd": F.concat_ws("/", year, month, day), "mail": F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@shop.example")),
        "uuid": F.concat_ws("-", hexed.substr(1, 8), hexed.substr(9, 4), hexed.substr(13, 4), hexed.substr(17, 4), hexed.substr(21, 12)),
        "share": F.concat((k % 100).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("%")),
        "money": F.concat(F.lit("$"), F.format_number(whole, 0), F.lit("."), rest), "count": (k % 1000).cast("string"),
        "padded": F.lpad((k % 1000).cast("string"), 5, "0"), "price": F.concat(whole.cast("string"), F.lit("."), rest),
        "phone": F.concat(F.lit("(555) "), F.lpad((k % 10000000).cast("string"), 7, "0")),
        "status": F.col("o_orderstatus"), "code": F.concat(F.lit("ORD-"), k.cast("string")), "priority": F.col("o_orderpriority"),
        "mixed": F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit(".5"))),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("path"), c.alias("value")) for n, c in forms.items()])
    return orders.select(F.col("o_orderkey").alias("pos"), F.explode(pairs).alias("p")).select("pos", "p.*")


_CENTS = "round(o_totalprice * 100)::BIGINT"
_FORMS = {
    "flag": "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'FALSE' END", "day": "strftime(o_orderdate, '%Y-%m-%d')",
    "moment": "strftime(o_orderdate, '%Y-%m-%dT08:00:00Z')", "day_us": "strftime(o_orderdate, '%m/%d/%Y')",
    "day_eu": "strftime(o_orderdate, '%d/%m/%Y')", "day_ymd": "strftime(o_orderdate, '%Y/%m/%d')",
    "mail": "'c' || o_custkey || '@shop.example'",
    "uuid": "md5(o_orderkey::VARCHAR)[1:8] || '-' || md5(o_orderkey::VARCHAR)[9:12] || '-' || md5(o_orderkey::VARCHAR)[13:16] || '-' || md5(o_orderkey::VARCHAR)[17:20] || '-' || md5(o_orderkey::VARCHAR)[21:32]",
    "share": "(o_orderkey % 100) || '.' || (o_orderkey % 10) || '%'",
    "money": f"'$' || format('{{:,}}', {_CENTS} // 100) || '.' || lpad(({_CENTS} % 100)::VARCHAR, 2, '0')",
    "count": "(o_orderkey % 1000)::VARCHAR", "padded": "lpad((o_orderkey % 1000)::VARCHAR, 5, '0')",
    "price": f"({_CENTS} // 100) || '.' || lpad(({_CENTS} % 100)::VARCHAR, 2, '0')",
    "phone": "'(555) ' || lpad((o_orderkey % 10000000)::VARCHAR, 7, '0')", "status": "o_orderstatus",
    "code": "'ORD-' || o_orderkey", "priority": "o_orderpriority",
    "mixed": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE o_orderkey || '.5' END",
}
_FORMATTED = "vals AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS pos, '{n}' AS path, {c} AS value FROM orders" for n, c in _FORMS.items()) + ")"


def _all(rx: str) -> str:
    return f"bool_and(regexp_matches(value, '{rx}'))"


# The chain written once more, over value lists without a sample.
_MDY = "(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/[0-9]{4}"
_DMY = "(0?[1-9]|[12][0-9]|3[01])/(0?[1-9]|1[0-2])/[0-9]{4}"
_KIND_SQL = f"""CASE WHEN {_all('^(?i)(true|false)$')} THEN 'bool' WHEN {_all('^[0-9]{4}-[0-9]{2}-[0-9]{2}$')} THEN 'date-iso'
 WHEN {_all('^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(.[0-9]{1,3})?(Z|[+-][0-9]{2}:[0-9]{2})?$')} THEN 'datetime-iso'
 WHEN {_all('^[0-9]{4}/(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])$')} THEN 'date-slash-ymd' WHEN {_all(f'^{_MDY}$')} THEN 'date-us'
 WHEN {_all(f'^{_DMY}$')} THEN 'date-eu' WHEN {_all('^[^ @]+@[^ @]+[.][^ @]+$')} THEN 'email'
 WHEN {_all('^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')} THEN 'uuid' WHEN {_all('^-?[0-9]+([.][0-9]+)?%$')} THEN 'percent'
 WHEN {_all('^-?[0-9]+$')} AND bool_or(regexp_matches(value, '^-?0[0-9]+$')) THEN 'int-padded' WHEN {_all('^-?[0-9]+$')} THEN 'int'
 WHEN {_all('^-?[0-9]+[.][0-9]+$')} THEN 'float' WHEN {_all('^[$€£]?-?([0-9]{1,3}(,[0-9]{3})*|[0-9]+)([.][0-9]+)?$')} THEN 'currency'
 WHEN {_all('^[+]?[0-9 ().-]{7,20}$')} AND min(length(regexp_replace(value, '[^0-9]', '', 'g'))) >= 7 THEN 'phone'
 WHEN {_all('^[A-Za-z]+$')} THEN 'alpha' WHEN {_all('^[A-Za-z0-9_-]+$')} THEN 'alnum' ELSE 'string' END"""


@query("i7_detect_kind", f"WITH {_FORMATTED} SELECT path, {_KIND_SQL} AS kind FROM vals GROUP BY path")
def i7(spark, sf_dir):
    return I.detect_kinds(formatted_values(table(spark, sf_dir, "orders"))).select("path", "kind")


@query("i7_detect_kind_sample", f"""WITH {_FORMATTED}, s AS (SELECT path, max(value) AS sample FROM vals GROUP BY path)
SELECT path, CASE WHEN path IN ('day_us', 'day_eu') THEN CASE WHEN regexp_matches(sample, '^{_DMY}$') THEN 'date-eu' ELSE 'date-us' END
 WHEN path = 'mixed' THEN CASE WHEN contains(sample, '.') THEN 'float' ELSE 'int' END
 ELSE map {{'flag': 'bool', 'day': 'date-iso', 'moment': 'datetime-iso', 'day_ymd': 'date-slash-ymd', 'mail': 'email', 'uuid': 'uuid', 'share': 'percent',
 'money': 'currency', 'count': 'int', 'padded': 'int-padded', 'price': 'float', 'phone': 'phone', 'status': 'alpha', 'code': 'alnum',
 'priority': (SELECT {_KIND_SQL} FROM (SELECT sample AS value FROM s WHERE path = 'priority'))}}[path] END AS kind FROM s""")
def i7_sample(spark, sf_dir):
    values = formatted_values(table(spark, sf_dir, "orders"))
    samples = values.groupBy("path").agg(F.max("value").alias("sample"))
    return I.detect_kinds(values, samples).select("path", "kind")


_NUM = "regexp_replace(value, '[$€£,%]', '', 'g')"


@query("i8_kind_stats", f"""WITH {_FORMATTED}, g AS (SELECT path, {_KIND_SQL} AS kind, min(length(value)) AS mn, max(length(value)) AS mx,
   min(try_cast({_NUM} AS DOUBLE)) AS lo, max(try_cast({_NUM} AS DOUBLE)) AS hi, max(length(regexp_extract(value, '[.]([0-9]+)', 1))) AS places,
   bool_or(contains(value, ',')) AS comma FROM vals GROUP BY path)
SELECT path, CASE kind WHEN 'bool' THEN 4 WHEN 'date-iso' THEN 10 WHEN 'datetime-iso' THEN 19 WHEN 'uuid' THEN 36 WHEN 'date-us' THEN 8 WHEN 'date-eu' THEN 8 WHEN 'date-slash-ymd' THEN 8 ELSE mn END::INT AS min_len,
  CASE kind WHEN 'bool' THEN 5 WHEN 'date-iso' THEN 10 WHEN 'datetime-iso' THEN 30 WHEN 'uuid' THEN 36 WHEN 'date-us' THEN 10 WHEN 'date-eu' THEN 10 WHEN 'date-slash-ymd' THEN 10 ELSE mx END::INT AS max_len,
  CASE WHEN kind IN ('percent', 'int', 'int-padded', 'float', 'currency') THEN lo END AS min_num, CASE WHEN kind IN ('percent', 'int', 'int-padded', 'float', 'currency') THEN hi END AS max_num,
  CASE WHEN kind IN ('percent', 'float', 'currency') THEN places END::INT AS decimals, CASE WHEN kind = 'int-padded' THEN mx END::INT AS pad_width,
  CASE WHEN kind = 'currency' THEN CASE path WHEN 'money' THEN '$' ELSE '$' END END AS prefix, CASE WHEN kind = 'currency' THEN comma END AS thousands FROM g""")
def i8(spark, sf_dir):
    return I.detect_kinds(formatted_values(table(spark, sf_dir, "orders"))).drop("kind")


@query("i9_loose_number", f"WITH {_FORMATTED} SELECT path, pos, try_cast({_NUM} AS DOUBLE) AS number FROM vals")
def i9(spark, sf_dir):
    v = formatted_values(table(spark, sf_dir, "orders"))
    return v.select("path", "pos", K.loose_number(F.col("value")).alias("number"))


@query("i10_coerce_sample", f"""WITH {_FORMATTED}, t AS (SELECT path, pos, CASE WHEN path = 'flag' AND pos % 3 = 0 THEN ' null ' WHEN path = 'flag' AND pos % 3 = 1 THEN ' ' ELSE value END AS value FROM vals)
SELECT path, pos, CASE WHEN trim(value) = '' THEN 'text' WHEN trim(value) IN ('true', 'false') THEN 'bool' WHEN trim(value) = 'null' THEN 'null'
  WHEN regexp_matches(trim(value), '^-?[0-9]+$') THEN 'int' WHEN regexp_matches(trim(value), '^-?[0-9]+[.][0-9]+$') THEN 'float' ELSE 'text' END AS type,
  CASE WHEN trim(value) = 'null' THEN NULL WHEN regexp_matches(trim(value), '^-?[0-9]+$') THEN trim(value)::BIGINT::VARCHAR WHEN trim(value) = '' THEN '' ELSE value END AS text FROM t""")
def i10(spark, sf_dir):
    v = formatted_values(table(spark, sf_dir, "orders"))
    blank = F.when((F.col("path") == "flag") & (F.col("pos") % 3 == 0), " null ").when(
        (F.col("path") == "flag") & (F.col("pos") % 3 == 1), " ").otherwise(F.col("value"))
    return v.select("path", "pos", K.coerced_type(blank).alias("type"), K.coerced_text(blank).alias("text"))


@query("i11_schema_samples", f"""WITH {_DOC_LEAVES}, {_TREE},
 f AS (SELECT path, arg_min(value, {{'e': event_id, 'a': a, 'b': b}}) FILTER (value <> '') AS sample FROM leaf GROUP BY path)
SELECT 'seen/' || path AS category, 'seen/' || path AS key_name, sample AS value FROM f WHERE trim(sample) <> ''""")
def i11(spark, sf_dir):
    rows = I.schema_rows(_leaves(spark, sf_dir))
    return I.schema_samples(rows, write_key(F.col("path"), F.lit(None).cast("string"), F.lit("seen")))


@query("i12_scan_counts", "SELECT count(*) AS records, count(*) AS scanned FROM events")
def i12(spark, sf_dir):
    return I.scan_counts(table(spark, sf_dir, "events"))


@query("i13_infer_corpus", f"""WITH {_DOC_LEAVES}, {_TREE}, s AS (SELECT event_type, path, arg_min(value, {{'e': event_id, 'a': a, 'b': b}}) AS sample FROM leaf WHERE value <> '' GROUP BY ALL)
SELECT f.event_type, f.path, f.kind, s.sample, f.kind = 'value' AND ends_with(name, '_id') AS is_primary FROM flags f LEFT JOIN s ON s.event_type = f.event_type AND s.path = f.path""")
def i13(spark, sf_dir):
    rows = I.schema_rows(_leaves(spark, sf_dir, ["event_type"]), ["event_type"])
    return rows.select("event_type", "path", "kind", "sample", "is_primary")


@query("i14_umbrella_schema", f"""WITH {_DOC_LEAVES}, {_TREE}
SELECT event_type || '.json' AS path, event_type || '.json' AS name, '' AS parent, 'object' AS kind FROM (SELECT DISTINCT event_type FROM flags)
UNION ALL SELECT event_type || '.json/' || path, name, event_type || '.json' || CASE WHEN parent = '' THEN '' ELSE '/' || parent END, kind FROM flags""")
def i14(spark, sf_dir):
    rows = I.schema_rows(_leaves(spark, sf_dir, ["event_type"]), ["event_type"])
    rows = rows.withColumns({"member": F.concat("event_type", F.lit(".json")), "package": F.lit("p")})
    return I.umbrella_rows(rows, ["package"], "member").drop("package")


@query("i15_schema_hash", """SELECT c_custkey, sha256('{"name":"' || c_name || '","csvTiedFieldPaths":[],"root":[{"key":"id","kind":"value","sampleValue":"' || c_custkey
 || '","isPrimary":true,"isUnique":true,"children":[]},{"key":"segment","kind":"value","sampleValue":"' || c_mktsegment || '","nullRate":' || (1 + c_nationkey)
 || ',"isPrimary":false,"isUnique":false,"children":[]}]}')[1:16] AS schema_hash FROM customer""")
def i15(spark, sf_dir):
    def leaf(key: str, sample: Column, flag: bool, rate: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.lit("value").alias("kind"), sample.alias("sample"),
                        rate.alias("null_rate"), F.lit(flag).alias("is_primary"), F.lit(flag).alias("is_unique"))
    doc = F.to_json(F.struct(F.col("c_name").alias("name"), F.array(
        leaf("id", F.col("c_custkey").cast("string"), True, F.lit(0)),
        leaf("segment", F.col("c_mktsegment"), False, F.col("c_nationkey") + 1)).alias("root")))
    customers = table(spark, sf_dir, "customer")
    return customers.select("c_custkey", schema_hash(doc).alias("schema_hash"))


# -- keys of fields, and values of a run -------------------------------------------------------
def _field_columns() -> dict[str, Column]:
    e, kind = F.col("event_id"), F.col("event_type")
    return {"path": F.concat(F.lit("log."), kind), "pool": F.when(e % 5 == 0, F.concat(F.lit(" "), kind, F.lit(" "))),
            "override": F.when(e % 3 == 0, F.upper(kind)).when(e % 3 == 1, F.lit("Shop")),
            "sources": F.when(e % 2 == 0, F.array(F.concat(F.lit("LOG."), kind), F.lit(" extra "), F.lit("Extra"), F.lit("")))}


_WRITE = "CASE WHEN event_id % 5 = 0 THEN 'pool:' || event_type WHEN event_id % 3 = 1 THEN 'Shop/log.' || event_type ELSE 'log.' || event_type END"


@query("h1_write_key", f"SELECT event_id, {_WRITE} AS write_key FROM events")
def h1(spark, sf_dir):
    c = _field_columns()
    return table(spark, sf_dir, "events").select("event_id", write_key(c["path"], c["pool"], c["override"]).alias("write_key"))


@query("h2_read_keys", f"""SELECT event_id, {_WRITE} || CASE WHEN {_WRITE} = 'log.' || event_type THEN '' ELSE '|log.' || event_type END
  || CASE WHEN event_id % 2 = 0 THEN '|extra' ELSE '' END AS read_keys FROM events""")
def h2(spark, sf_dir):
    c = _field_columns()
    keys = read_keys(c["path"], c["pool"], c["override"], c["sources"])
    return table(spark, sf_dir, "events").select("event_id", F.array_join(keys, "|").alias("read_keys"))


_AMT = f"(({Leaf(SEED, 'amount', 'o_orderkey').below('number', 201)} + 25) / 10.0::DOUBLE)"


@query("h25_harvest_run", f"""WITH r AS (SELECT o_orderkey, 0 AS i, 'event' AS k, '892' AS value FROM orders UNION ALL
 SELECT o_orderkey, 2, 'amount', regexp_replace({_AMT}::VARCHAR, '\\.0$', '') FROM orders)
SELECT k AS category, k AS key_name, value FROM r ORDER BY o_orderkey, i LIMIT 5000""")
def h25(spark, sf_dir):
    schema = Schema("tied", [f for f in TIED.root if f.name in ("event", "amount", "case_id")], tied_paths=["event", "case_id"])
    untied = Schema("tied", schema.root, tied_paths=["CASE_ID"])
    run = generate_for(table(spark, sf_dir, "orders"), "o_orderkey", schema, SEED, keep=["o_orderkey"])
    return harvest_run(run, "o_orderkey", untied, cap=5000)
