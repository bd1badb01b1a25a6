"""Queries for sources, sinks, packages and streams.

Each one writes data derived from the tables to a scratch folder in the session's shared storage
and reads it back, or unfolds archives that the tasks have packed from table rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from synthmill.functions.batches import batched, rows_of
from synthmill.functions.naming import NameContext, Naming
from synthmill.functions.render import yaml_scalar
from synthmill.functions.scratch import scratch
from synthmill.operators import packages as P
from synthmill.plans import duck
from synthmill.plans.banking import STAMP, event_rows, now, _BANK, _T
from synthmill.plans.duck import Leaf, permuted
from synthmill.plans.generation import SEED, TIED, CUSTOMER
from synthmill.plans.registry import query, table
from synthmill.plans.reshaping import nested_orders
from synthmill.sinks import archives as A, files as W, records as K
from synthmill.sinks.records import write_files
from synthmill.sources import archives as R, files as S
from synthmill.streaming import jobs as J
from synthmill.streaming.bank_runs import read_bank

CUSTOMER_DDL = "id bigint, name string, segment string, note string"
_CUSTOMERS = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'say \"' || c_nationkey || ', ok\"' AS note FROM customer"


def customers(spark, sf_dir) -> DataFrame:
    note = F.concat(F.lit('say "'), F.col("c_nationkey").cast("string"), F.lit(', ok"'))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), note.alias("note"))


def _ids_as_numbers(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.col("id").cast("bigint"))


# -- one format out and in ---------------------------------------------------------------------
@query("s1_read_json", _CUSTOMERS)
def s1(spark, sf_dir):
    path = scratch(spark, "json")
    W.write_json(customers(spark, sf_dir), path)
    return S.read_json(spark, path, CUSTOMER_DDL)


@query("s2_read_ndjson", _CUSTOMERS + " WHERE c_custkey % 3 > 0")
def s2(spark, sf_dir):
    path = scratch(spark, "ndjson")
    line = F.to_json(F.struct("id", "name", "segment", "note"))
    customers(spark, sf_dir).select(F.when(F.col("id") % 3 == 0, F.lit("{broken")).otherwise(line)).write.text(path)
    return S.read_ndjson(spark, path, CUSTOMER_DDL)


@query("s3_read_csv", _CUSTOMERS)
def s3(spark, sf_dir):
    path = scratch(spark, "csv")
    W.write_csv(customers(spark, sf_dir), path)
    return _ids_as_numbers(S.read_csv(spark, path))


@query("s4_read_xml", _CUSTOMERS)
def s4(spark, sf_dir):
    path = scratch(spark, "xml")
    W.write_xml(customers(spark, sf_dir), path, root_tag="customers", record_tag="customer", style="repeated")
    return S.read_xml(spark, path, "customer", CUSTOMER_DDL)


@query("s5_read_yaml", _CUSTOMERS)
def s5(spark, sf_dir):
    path = scratch(spark, "yaml")
    df = customers(spark, sf_dir)
    lines = F.concat(*[F.concat(F.lit(("- " if c == "id" else "\n  ") + f"{c}: "), yaml_scalar(F.col(c))) for c in df.columns])
    df.select(lines).write.text(path)
    return S.read_yaml(spark, path, CUSTOMER_DDL)


def _mixed_texts(spark, sf_dir) -> DataFrame:
    """One file per event in seven forms, as (path, content)."""
    e, kind, props = F.col("event_id"), F.col("event_type"), F.col("props")
    m, user = e % 7, F.col("user_id").cast("string")
    ext = (F.when(m == 0, ".json").when(m == 1, ".jsonl").when(m == 2, ".txt").when(m == 3, ".YAML").when(m == 4, ".xml")
           .when(m == 5, ".csv").otherwise(".dat"))
    content = (F.when(m == 0, F.concat(F.lit("["), props, F.lit(","), props, F.lit("]")))
               .when(m == 1, F.concat(props, F.lit("\n{bad\n"), props, F.lit("\n")))
               .when(m == 2, F.concat(kind, F.lit(" "), user)).when(m == 3, F.concat(F.lit("k: "), user, F.lit("\nt: "), kind))
               .when(m == 4, F.concat(F.lit("<e k='1'><u>"), user, F.lit("</u><t>"), kind, F.lit("</t><t>x</t></e>")))
               .when(m == 5, F.concat(F.lit("u,t\n# note\n"), user, F.lit(',"'), kind, F.lit(', ""q"""\n')))
               .otherwise(F.concat(F.lit("k: "), user, F.lit("\n"))))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("in/f"), e.cast("string"), ext).alias("path"), content.alias("content"))


_EXT = "CASE event_id % 7 WHEN 0 THEN '.json' WHEN 1 THEN '.jsonl' WHEN 2 THEN '.txt' WHEN 3 THEN '.YAML' WHEN 4 THEN '.xml' WHEN 5 THEN '.csv' ELSE '.dat' END"
_FILE = f"'in/f' || event_id || {_EXT}"


@query("s6_read_txt", f"""SELECT {_FILE} AS path, i::INT AS record, CASE event_id % 7
   WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN json_extract_string(props, '$.k') WHEN 2 THEN event_type || ' ' || user_id
   WHEN 3 THEN user_id || '|' || event_type WHEN 4 THEN user_id || '|1' WHEN 5 THEN user_id || '|' || event_type || ', "q"' ELSE user_id::VARCHAR END AS value
FROM events, range(2) t(i) WHERE i = 0 OR event_id % 7 < 2""")
def s6(spark, sf_dir):
    docs = S.documents(_mixed_texts(spark, sf_dir)).where("error IS NULL")
    def at(p: str):
        return F.get_json_object("document", p)
    array = F.coalesce(at(f"$[0].k"), at("$.k"))
    exploded = docs.select("path", "record", "document", F.explode(F.when(F.startswith("document", F.lit("[")), F.array(F.lit(0), F.lit(1)))
                           .otherwise(F.array(F.lit(-1)))).alias("i"))
    value = F.concat_ws("|", F.coalesce(array, at("$.content"), at("$.u"), at("$.e.u")), F.coalesce(at("$.t"), at("$.e['@_k']")))
    return exploded.select("path", F.when(F.col("i") >= 0, F.col("i")).otherwise(F.col("record")).alias("record"), value.alias("value"))


_SUPPLIER_FILE = "'f' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.csv' ELSE '.txt' END"


@query("s6_read_txt_files", f"""SELECT {_SUPPLIER_FILE} AS file, i::INT AS record, s_name AS value
FROM supplier, range(2) t(i) WHERE i = 0 OR s_suppkey % 3 < 2""")
def s6_files(spark, sf_dir):
    """A file for each supplier in one of three formats, read back from its folder."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    form = k % 3
    line = F.concat(F.lit('{"n":"'), name, F.lit('"}'))
    content = F.when(form == 0, F.concat_ws("\n", line, line)).when(form == 1, F.concat_ws("\n", F.lit("n"), name, name)).otherwise(name)
    ending = F.when(form == 0, ".json").when(form == 1, ".csv").otherwise(".txt")
    folder = scratch(spark, "texts")
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), k.cast("string"), ending).alias("path"), content.alias("content"))
    write_files(files, folder)
    value = F.coalesce(F.get_json_object("document", "$.n"), F.get_json_object("document", "$.content"))
    return S.read_txt(spark, folder).select(F.substring_index("path", "/", -1).alias("file"), "record", value.alias("value"))


@query("s7_sniff_format", f"SELECT {_FILE} AS path, CASE event_id % 7 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'txt' WHEN 3 THEN 'yaml' WHEN 4 THEN 'xml' WHEN 5 THEN 'csv' ELSE 'yaml' END AS format FROM events")
def s7(spark, sf_dir):
    files = _mixed_texts(spark, sf_dir)
    return files.select("path", S.sniff_format(F.col("path"), F.col("content")).alias("format"))


# -- archives -----------------------------------------------------------------------------------
def packed_customers(spark, sf_dir) -> DataFrame:
    """Archives (path, content), packed in tasks: one per customer, with an inner archive and an unwanted file."""

    def rows(batches):
        for e, kind, props in rows_of(batches, "c_custkey", "c_mktsegment", "props"):
            fmt = ("zip", "tar", "tar.gz")[e % 3]
            inner = A.pack([("deep/n.json", props.encode()), ("x.bin", b"\0\1")], "tar.gz")
            entries = [("a.json", props.encode()), ("Sub/in.tgz", inner), ("sub/A.csv", f"k,t\n{e},{kind}\n".encode()),
                       ("SUB/a.CSV", b"twin"), ("bad.zip", b"no archive")]
            yield f"p{e}.{fmt}", A.pack(entries, fmt)

    packed = pa.schema([("path", pa.string()), ("content", pa.binary())])

    props = F.concat(F.lit('{"k": '), F.col("c_nationkey").cast("string"), F.lit("}")).alias("props")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", props).mapInArrow(
        lambda batches: batched(rows(batches), packed), "path string, content binary")


_PACKED = """packed AS (SELECT c_custkey, c_mktsegment, '{"k": ' || c_nationkey || '}' AS props FROM customer)"""
_PACK = "'p' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.tar' ELSE '.tar.gz' END"
_ENTRIES = """(VALUES (0, 'file', 'a.json', NULL), (1, 'nested', 'Sub/in', NULL), (2, 'file', 'Sub/in/deep/n.json', NULL), (3, 'skipped', 'Sub/in/x.bin', 'not a text file'),
 (4, 'file', 'sub/A.csv', NULL), (5, 'file', 'SUB/a.CSV', NULL), (6, 'nested', 'bad', NULL), (7, 'skipped', 'bad.zip', 'unreadable archive: BadZipFile')) v(i, kind, entry, reason)"""


@query("s8_expand_archives", f"WITH {_PACKED} SELECT {_PACK} AS path, kind, entry, reason, CASE WHEN i IN (0, 2) THEN props WHEN i = 4 THEN 'k,t' || chr(10) || c_custkey || ',' || c_mktsegment || chr(10) WHEN i = 5 THEN 'twin' END AS text FROM packed, {_ENTRIES}")
def s8(spark, sf_dir):
    return R.expand_archives(packed_customers(spark, sf_dir)).select("path", "kind", "entry", "reason", F.decode("content", "UTF-8").alias("text"))


@query("s9_list_archive", f"WITH {_PACKED} SELECT {_PACK} AS path, entry, is_directory FROM packed, (VALUES ('a.json', false), ('Sub/in.tgz', false), ('sub/A.csv', false), ('bad.zip', false)) v(entry, is_directory)")
def s9(spark, sf_dir):
    return R.list_archive(packed_customers(spark, sf_dir)).select("path", "entry", "is_directory")


@query("s10_read_entry", f"WITH {_PACKED} SELECT {_PACK} AS path, 'a.json' AS entry, length(props)::BIGINT AS size, false AS binary, false AS truncated, props AS content FROM packed")
def s10(spark, sf_dir):
    return R.read_entry(packed_customers(spark, sf_dir), "/A.JSON")


@query("s11_read_folder", "SELECT 'seg=' || c_mktsegment || '/c' || c_custkey || '.txt' AS path, length(c_name)::BIGINT AS size, c_name AS text FROM customer")
def s11(spark, sf_dir):
    folder = scratch(spark, "folder")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("seg="), "c_mktsegment", F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("path"), F.col("c_name").alias("content"))
    K.write_files(rows, folder)
    return S.read_folder(spark, folder).select("path", "size", F.decode("content", "UTF-8").alias("text"))


@query("s12_classify_files", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'not a text file' WHEN page_id % 3 = 1 AND length(html) * 10000 > 26214400 THEN 'too large' END AS reason FROM pages")
def s12(spark, sf_dir):
    k = F.col("page_id") % 3
    files = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("d/p."), F.when(k == 0, "png").when(k == 1, "HTML").otherwise("log")).alias("path"),
        F.when(k == 1, F.length("html") * 10000).otherwise(1).alias("size"))
    return S.classify_files(files, max_bytes=25 << 20).select("page_id", "reason")


# -- sinks ----------------------------------------------------------------------------------------
@query("k1_write_json", _CUSTOMERS)
def k1(spark, sf_dir):
    path = scratch(spark, "json")
    W.write_json(customers(spark, sf_dir).repartition(3), path)
    return S.read_json(spark, path).select(F.col("id").cast("bigint").alias("id"), "name", "segment", "note")


@query("k2_write_ndjson", _CUSTOMERS)
def k2(spark, sf_dir):
    path = scratch(spark, "ndjson")
    W.write_ndjson(customers(spark, sf_dir), path)
    return S.read_ndjson(spark, path, CUSTOMER_DDL)


def _lines(spark, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("line"))


@query("k3_write_csv", '''SELECT c_custkey || ',' || c_name || ',' || c_mktsegment || ',"say ""' || c_nationkey || ', ok"""' AS line FROM customer''')
def k3(spark, sf_dir):
    path = scratch(spark, "csv")
    W.write_csv(customers(spark, sf_dir), path)
    return _lines(spark, path).where("line <> 'id,name,segment,note'")


def nested(spark, sf_dir) -> DataFrame:
    return nested_orders(table(spark, sf_dir, "orders")).drop("tags")


@query("k4_write_csv_entities", """SELECT '0' || '|' || o_orderkey || ',' || o_orderstatus AS line FROM orders UNION ALL SELECT '2|' || o_orderpriority FROM orders UNION ALL SELECT '1|' || o_custkey FROM orders
UNION ALL SELECT '3|S' || (o_custkey + i) || ',' || ((o_orderkey + i) % 7) FROM orders, range(3) t(i) WHERE i < o_orderkey % 4
UNION ALL SELECT unnest(['0|# entity: root', '0|id,status', '1|', '1|# entity: customer', '1|id', '2|', '2|# entity: customer.tier', '2|level', '3|', '3|# entity: items', '3|sku,qty'])""")
def k4(spark, sf_dir):
    path = scratch(spark, "entities")
    blocks = W.entity_blocks(nested(spark, sf_dir), "id")
    ordered = blocks.withColumn("line", F.explode(F.split("line", "\n"))).withColumn(
        "line", F.concat_ws("|", F.col("block").cast("string"), F.col("line")))
    W.write_blocks(ordered, path)
    return _lines(spark, path)


@query("k4_csv_entity_folders", """SELECT 'root|' || o_orderkey || ',' || o_orderkey || ',' || o_orderstatus AS line FROM orders
UNION ALL SELECT 'customer|' || o_orderkey || ',' || o_custkey FROM orders UNION ALL SELECT 'customer.tier|' || o_orderkey || ',' || o_orderpriority FROM orders
UNION ALL SELECT 'items|' || o_orderkey || ',' || i || ',S' || (o_custkey + i) || ',' || ((o_orderkey + i) % 7) FROM orders, range(3) t(i) WHERE i < o_orderkey % 4""")
def k4_folders(spark, sf_dir):
    """Each entity's own CSV data set, without the header lines of its part files."""
    path = scratch(spark, "entity-folders")
    W.write_csv_entities(nested(spark, sf_dir), "id", path)
    return spark.read.text(path).where(~F.startswith("value", F.lit("_record,"))).select(F.concat_ws("|", "entity", "value").alias("line"))


@query("k5_write_csv_per_key", '''SELECT 'name' AS line UNION ALL SELECT 'segment' UNION ALL SELECT 'note' UNION ALL SELECT '' FROM range(2)
UNION ALL SELECT c_name FROM customer UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT '"say ""' || c_nationkey || ', ok"""' FROM customer''')
def k5(spark, sf_dir):
    path = scratch(spark, "keys")
    W.write_csv_per_key(customers(spark, sf_dir), "id", path)
    return _lines(spark, path)


@query("k6_write_xml", """SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority AS level, CASE WHEN o_orderkey % 4 > 1 THEN 'S' || (o_custkey + 1) END AS second FROM orders""")
def k6(spark, sf_dir):
    path = scratch(spark, "xml")
    W.write_xml(nested(spark, sf_dir), path, root_tag="all orders", record_tag="order")
    schema = ("id bigint, customer struct<id: bigint, tier: struct<level: string>>, items struct<items_1: struct<sku: string, qty: bigint>>")
    back = S.read_xml(spark, path, "order", schema)
    return back.select("id", F.col("customer.id").alias("cust"), "customer.tier.level", F.col("items.items_1.sku").alias("second"))


@query("k7_write_yaml", "SELECT unnest(['---', 'id: ' || c_custkey, 'name: ' || c_name, 'segment: ' || c_mktsegment]) AS line FROM customer")
def k7(spark, sf_dir):
    path = scratch(spark, "yaml")
    W.write_yaml(customers(spark, sf_dir).drop("note"), path)
    return _lines(spark, path)


@query("k8_write_txt", """SELECT c_name AS line FROM customer UNION ALL SELECT '{"id":' || c_custkey || ',"segment":"' || c_mktsegment || '"}' FROM customer""")
def k8(spark, sf_dir):
    plain, records = scratch(spark, "txt"), scratch(spark, "txt")
    df = customers(spark, sf_dir)
    W.write_txt(df.select("name"), plain)
    W.write_txt(df.select("id", "segment"), records)
    return _lines(spark, plain).unionByName(_lines(spark, records))


_SEGMENT_NO = "row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey)"


@query("k9_write_per_record", f"""WITH r AS (SELECT *, {_SEGMENT_NO} AS n FROM customer)
SELECT lower(c_mktsegment) || '/x' || CASE WHEN n = 1 THEN '' ELSE '_' || n END || '.xml' AS path,
 '<root>' || chr(10) || '  <name>' || c_name || '</name>' || chr(10) || '  <segment>' || lower(c_mktsegment) || '</segment>' || chr(10) || '</root>' AS text FROM r""")
def k9(spark, sf_dir):
    folder = scratch(spark, "records")
    df = customers(spark, sf_dir).select("id", "name", F.lower("segment").alias("segment"))
    ctx = NameContext(df.schema, "customer", "xml", 0, SEED)
    K.write_per_record(df, "id", folder, Naming("{field:segment}/x.{ext}"), ctx)
    return S.read_folder(spark, folder).select("path", F.decode("content", "UTF-8").alias("text"))


def _unpacked(spark, folder: str) -> DataFrame:
    files = S.read_folder(spark, folder).withColumn("path", F.regexp_replace("path", "^.*/", ""))
    return R.expand_archives(files).where("kind = 'file'").select("path", "entry", F.decode("content", "UTF-8").alias("text"))


@query("k10_write_archive", """SELECT lower(event_type) || '.tar.gz' AS path, 'top/e' || event_id || '.json' AS entry, props AS text FROM events""")
def k10(spark, sf_dir):
    from synthmill.functions.ranks import grouped_rank
    folder = scratch(spark, "archives")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(".tar.gz")).alias("archive"), "props")
    pieces = grouped_rank(rows, ["archive"], "event_id", "no").select(
        "archive", (F.col("no") - 1).alias("entry_no"), F.concat(F.lit("top/e"), F.col("event_id").cast("string"), F.lit(".json")).alias("entry"),
        F.lit(0).alias("seq"), F.col("props").alias("text"))
    A.write_archives(pieces, folder, "tar.gz").agg(F.sum("bytes")).collect()
    return _unpacked(spark, folder)


def _numbered(spark, sf_dir) -> DataFrame:
    from synthmill.functions.ranks import row_index
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return row_index(df, "id", "no")


@query("k11_write_multi_format", """SELECT 'pack.zip' AS path, 'out/c.csv' AS entry, 'id,name' || chr(10) || string_agg(c_custkey || ',' || c_name, chr(10) ORDER BY c_custkey) AS text FROM customer
UNION ALL SELECT 'pack.zip', 'out/c.yml', string_agg('- id: ' || c_custkey || chr(10) || '  name: ' || c_name || chr(10), '' ORDER BY c_custkey) FROM customer
UNION ALL SELECT 'pack.zip', 'out/c.json', '[' || chr(10) || string_agg('  {' || chr(10) || '    "id": ' || c_custkey || ',' || chr(10) || '    "name": "' || c_name || '"' || chr(10) || '  }', ',' || chr(10) ORDER BY c_custkey) || chr(10) || ']' FROM customer""")
def k11(spark, sf_dir):
    folder = scratch(spark, "multi")
    pieces = A.multi_format_pieces(_numbered(spark, sf_dir), "no", [("c", "csv"), ("c", "yaml"), ("c.json", "json")], "pack.zip", "out")
    A.write_archives(pieces, folder, "zip").agg(F.sum("bytes")).collect()
    return _unpacked(spark, folder)


@query("k12_write_split", """WITH n AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS total FROM customer), b AS (SELECT *, i // ceil(total / 4)::BIGINT AS batch FROM n)
SELECT 'split.tar' AS path, 'b' || batch || '.xml' AS entry, '<root>' || chr(10) || string_agg('  <record>' || chr(10) || '    <id>' || c_custkey || '</id>' || chr(10) || '    <name>' || c_name || '</name>' || chr(10) || '  </record>', chr(10) ORDER BY c_custkey)
 || chr(10) || '</root>' AS text FROM b GROUP BY batch""")
def k12(spark, sf_dir):
    folder = scratch(spark, "split")
    pieces = A.split_pieces(_numbered(spark, sf_dir), "no", [(f"b{i}", "xml") for i in range(4)], "split.tar")
    A.write_archives(pieces, folder, "tar").agg(F.sum("bytes")).collect()
    return _unpacked(spark, folder)


@query("x14_convert", _CUSTOMERS)
def x14(spark, sf_dir):
    first, second = scratch(spark, "in"), scratch(spark, "out")
    W.write_csv(customers(spark, sf_dir), first)
    W.convert(_ids_as_numbers(S.read_csv(spark, first)), "json", second)
    return S.read_json(spark, second, CUSTOMER_DDL)


# -- packages -----------------------------------------------------------------------------------
def imported(spark, sf_dir) -> P.Imported:
    return P.import_packages(packed_customers(spark, sf_dir))


_MEMBERS = """(VALUES ('a.json', 'k', 'value'), ('Sub/in/deep/n.json', 'k', 'value'), ('sub/A.csv', 'k', 'value'), ('sub/A.csv', 't', 'value'), ('SUB/a.CSV', 'twin', 'value')) v(member, leaf, kind)"""


@query("p1_import_packages", f"""WITH {_PACKED} SELECT {_PACK} AS package, member, leaf AS path, kind, CASE WHEN member LIKE '%json' THEN json_extract_string(props, '$.k') WHEN leaf = 'k' THEN c_custkey::VARCHAR WHEN leaf = 't' THEN c_mktsegment END AS sample FROM packed, {_MEMBERS}""")
def p1(spark, sf_dir):
    return imported(spark, sf_dir).schemas.select("package", "member", "path", "kind", "sample")


@query("p1_import_skipped", f"WITH {_PACKED} SELECT {_PACK} AS package, entry AS path, reason FROM packed, {_ENTRIES} WHERE kind = 'skipped'")
def p1_skipped(spark, sf_dir):
    return imported(spark, sf_dir).skipped


@query("p2_nested_map", f"WITH {_PACKED} SELECT {_PACK} AS package, folder_path, archive_path, archive_format FROM packed, (VALUES ('Sub/in', 'Sub/in.tgz', 'tar.gz'), ('bad', 'bad.zip', 'zip')) v(folder_path, archive_path, archive_format)")
def p2(spark, sf_dir):
    return P.nested_map(imported(spark, sf_dir).members)


@query("p3_hydrate", f"""WITH {_PACKED} SELECT {_PACK} AS package, path, kind, n::INT AS schema_fields FROM packed,
 (VALUES ('a.json', 'text', 1), ('Sub/in/deep/n.json', 'text', 1), ('sub/A.csv', 'text', 2), ('SUB/a.CSV', 'text', 1), ('Sub/in', 'nested_archive_folder', NULL), ('bad', 'nested_archive_folder', NULL)) v(path, kind, n)""")
def p3(spark, sf_dir):
    got = imported(spark, sf_dir)
    return P.hydrate(got.members, got.schemas).select("package", "path", "kind", F.size("schema_rows").alias("schema_fields"))


PACKAGE = [P.Member("in/case.xml", TIED, "xml"), P.Member("c.json", CUSTOMER, "json")]
MODES = {"in/case.xml": {"case_id": "unique", "event": "same", "amount": "random", "owner.name": "same", "owner.team": "same"},
         "c.json": {"customer_id": "same", "full_name": "same", "email": "same", "signup_date": "same"}}
_CASE = Leaf(SEED, "in/case.xml:amount", "c_custkey")
_FIRST = Leaf(SEED, "in/case.xml:owner.name", "0")
_BALANCE = Leaf(SEED, "c.json:balance", "c_custkey")


def _decimal(units: str, places: int) -> str:
    return f"regexp_replace((({units}) / {10 ** places}.0::DOUBLE)::VARCHAR, '\\.0$', '')"


_XML_CONTENT = f"""'<root>' || chr(10) || '  <case_id>' || {duck.let(duck.permuted_wide('c_custkey', 62 ** 6, SEED, 'in/case.xml:case_id'), lambda c: duck.spell(c, duck.ALNUM, 6))} || '</case_id>' || chr(10)
 || '  <event>892</event>' || chr(10) || '  <owner>' || chr(10) || '    <name>' || substr({_FIRST.text('text', duck.LOWER, 12)}, 1, 4 + {_FIRST.below('text-length', 9)}) || '</name>' || chr(10)
 || '    <team>true</team>' || chr(10) || '  </owner>' || chr(10) || '  <amount>' || {_decimal(f"{_CASE.below('number', 201)} + 25", 1)} || '</amount>' || chr(10) || '</root>'"""
_JSON_CONTENT = f"""'{{' || chr(10) || '  "customer_id": 10001,' || chr(10) || '  "full_name": "Robin Vale",' || chr(10) || '  "email": "jo.lee7@example.com",' || chr(10)
 || '  "signup_date": "2024-06-15",' || chr(10) || '  "balance": ' || {_decimal(f"{_BALANCE.below('number', 2001)} + 999", 2)} || chr(10) || '}}'"""
_VARIANTS = f"""SELECT c_custkey + 1 AS variant, 'in/case.xml' AS path, {_XML_CONTENT} AS content FROM customer UNION ALL SELECT c_custkey + 1, 'c.json', {_JSON_CONTENT} FROM customer"""


def made_variants(spark, sf_dir) -> DataFrame:
    return P.variant_rows(spark, PACKAGE, 2 ** 40, SEED, modes=MODES, rows=table(spark, sf_dir, "customer"), row_id="c_custkey")


@query("p4_variants", _VARIANTS)
def p4(spark, sf_dir):
    return made_variants(spark, sf_dir).select("variant", F.inline("files"))


@query("p5_repack", f"""WITH v AS ({_VARIANTS}) SELECT 'pkg_' || CASE WHEN variant < 10000 THEN lpad(variant::VARCHAR, 4, '0') ELSE variant::VARCHAR END || '.tar.gz' AS path, path AS entry, content AS text FROM v""")
def p5(spark, sf_dir):
    packed = P.repack(made_variants(spark, sf_dir), "pkg", "tar.gz", [P.NestedArchive("in", "in.zip", "zip")])
    return R.expand_archives(packed).where("kind = 'file'").select("path", "entry", F.decode("content", "UTF-8").alias("text"))


@query("p6_member_leaves", f"WITH {_PACKED} SELECT {_PACK} AS package, member, leaf AS path FROM packed, {_MEMBERS}")
def p6(spark, sf_dir):
    return P.member_leaves(imported(spark, sf_dir).schemas)


# -- streams --------------------------------------------------------------------------------------
def stream_events(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(stream: DataFrame, spark, name: str) -> DataFrame:
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-progress")
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


@query("t1_generate_stream", f"SELECT event_id, {permuted('event_id', 400_000_001, SEED, 'code')} + 800000000 AS code, {Leaf(SEED, 'pct', 'event_id').below('number', 21)} - 5 AS pct FROM events")
def t1(spark, sf_dir):
    from synthmill.schema import Field, Schema
    schema = Schema("s", [Field("code", sample="1000000000", is_unique=True), Field("pct", sample="5")])
    made = J.generate_stream(spark, schema, SEED, rows=stream_events(spark, sf_dir), row="event_id", keep=())
    return _drained(made, spark, "generated").withColumnRenamed("row", "event_id")


@query("t2_bank_stream", f"WITH {_BANK} SELECT id, key_name, value, use_count, strftime(last_used_at, '{_T}') AS last_used_at FROM bank")
def t2(spark, sf_dir):
    # All events, in two deliveries: the stream goes on where it stopped, and its second batch meets values of the first.
    arrived, folder, progress = (scratch(spark, name) for name in ("events", "bank", "bank-progress"))
    events = table(spark, sf_dir, "events")
    for delivery in (0, 1):
        events.where(F.col("event_id") % 2 == delivery).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(events.schema).parquet(arrived)
        J.bank_stream(event_rows(stream), folder, progress, now()).awaitTermination()
    return read_bank(spark, folder).select("id", "key_name", "value", "use_count", F.date_format("last_used_at", STAMP).alias("last_used_at"))


@query("t3_first_seen_stream", "SELECT DISTINCT event_type AS path, 'u' || lpad(user_id::VARCHAR, 6, '0') AS value FROM events UNION SELECT DISTINCT event_type || '.props', props FROM events")
def t3(spark, sf_dir):
    rows = event_rows(stream_events(spark, sf_dir)).select(F.col("key_name").alias("path"), "value", F.col("used_at").cast("timestamp").alias("used_at"))
    return _drained(J.first_seen_stream(rows), spark, "seen").select("path", "value")
