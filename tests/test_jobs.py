"""Bank, inference, reshape, files, packages, streams: rules that the queries do not cover."""

import io
import json
import os
import sys
import tarfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from synthmill.functions.render import csv_text, json_text, record_column, render, xml_tag, xml_text
from synthmill.operators import bank as B, infer as I, packages as P, reshape as R
from synthmill.operators.generate import SchemaPlan
from synthmill.operators.report import manifest_path, parse_manifests
from synthmill.plans.banking import empty_bank, now
from synthmill.plans.learn import learn, twin
from synthmill.schema import ARRAY, OBJECT, Field, Schema
from synthmill.sinks import archives as A, files as W, records as K
from synthmill.sources import archives as AR, files as S
from synthmill.streaming import jobs as J
from synthmill.streaming.bank_runs import bank_merger, read_bank
from tests.conftest import SF, executed_plan, plan_of
from synthmill.functions.naming import NameContext, Naming


def bank_of(spark, rows):
    df = spark.createDataFrame(rows, "category string, key_name string, value string")
    return B.record_use(empty_bank(spark), df, now())


def listed(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# -- bank -----------------------------------------------------------------------------------------
def test_use_counts_and_blank_values(spark):
    bank = bank_of(spark, [("A", "k", "x"), ("a ", "k", " x "), ("a", "k", " "), ("a", "k", None), ("", "k", "y")])
    assert listed(bank, "value", "use_count") == [("x", 2), ("y", 1)]
    again = B.record_ensure(bank, spark.createDataFrame([("A", "k", "x"), ("A", "k", "z")], "category string, key_name string, value string"), now())
    assert listed(again, "value", "use_count") == [("x", 2), ("y", 1), ("z", 1)]


def test_clear_is_complementary_and_guarded(spark):
    bank = bank_of(spark, [("a", "k", str(i)) for i in range(10)]).withColumn(
        "last_used_at", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(days=F.col("value").cast("int")))
    cutoff = datetime(2024, 1, 6)
    older, newer = B.clear(bank, "datetime", cutoff=cutoff), B.clear(bank, "datetime", cutoff=cutoff, age="newer")
    assert listed(older, "value") == [(str(i),) for i in range(5, 10)] and listed(newer, "value") == [(str(i),) for i in range(5)]
    for call in (lambda: B.clear(bank, "all"), lambda: B.clear(bank, "days", days=0), lambda: B.clear(bank, "days", days=40_000),
                 lambda: B.clear(bank, "datetime"), lambda: B.delete_matching(bank, bank, " "), lambda: B.clear(bank, "era")):
        with pytest.raises(ValueError):
            call()
    assert B.clear(bank, "all", confirm=True).count() == 0


def test_search_takes_wildcards_literally(spark):
    bank = bank_of(spark, [("a", "k", "50%"), ("a", "k", "50x"), ("a", "k", "a_b"), ("a", "k", "aXb")])
    assert listed(B.suggest(bank, prefix="50%"), "value") == [("50%",)]
    categories = B.ensure_categories(spark.createDataFrame([], "id string, name string, source_key string, created_at timestamp_ntz"),
                                     spark.createDataFrame([("a", "k", 0)], "category string, key_name string, pos int"), now())
    assert listed(B.search(bank, categories, "_"), "value") == [("a_b",)]
    assert B.page(bank, categories, 100, 10)[0].count() == 0


def test_correct_merges_into_a_twin(spark):
    bank = bank_of(spark, [("a", "k", "x")] * 3 + [("a", "k", "y")] * 2 + [("a", "j", "y")])
    ids = {(r["key_name"], r["value"]): r["id"] for r in bank.collect()}
    edits = spark.createDataFrame([(ids["k", "x"], " y "), (ids["j", "y"], "y")], "id string, value string")
    out = B.correct(bank, edits, now())
    assert listed(out, "id", "value", "use_count") == sorted([(ids["k", "y"], "y", 5), (ids["j", "y"], "y", 1)])


def test_ranked_values_are_cut_before_the_shuffle(spark):
    bank = spark.createDataFrame([], "id string, category_id string, key_name string, value string, use_count bigint, last_used_at timestamp_ntz, created_at timestamp_ntz")
    assert executed_plan(B.values_for_key(bank)).count("WindowGroupLimit") == 2
    leaves = I.leaves(spark.read.parquet(f"{SF}/customer.parquet"), "c_custkey")
    assert "WindowGroupLimit" in executed_plan(I.harvest_values(leaves, cap=200))


def test_values_of_several_keys(spark):
    bank = bank_of(spark, [("p", "p", v) for v in "aab"] + [("q", "q", v) for v in "bbc"] + [("other", "p", "z")])
    assert [r["value"] for r in B.values_for_keys(bank, ["Q", "p", "q"]).collect()] == ["b", "c", "a"]


# -- inference --------------------------------------------------------------------------------------
DOCS = ['{"id":1,"a":{"b":"","c":[1,2]},"l":[{"x":null},{"x":"u","y":2.50}],"e":[],"o":{},"m":5}',
        '[{"id":"7","a":{"b":"t"},"m":{"n":1}},3,[4,{"q":1}]]', "not json", "null"]


def test_documents_of_any_shape(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "pos int, doc string")
    rows = I.document_leaves(df, "doc", "pos")
    got = {(r["path"], r["value"]) for r in I.harvest_values(rows).collect()}
    assert got == {("id", "1"), ("id", "7"), ("a.b", "t"), ("a.c.item", "1"), ("a.c.item", "2"), ("l.x", "u"), ("l.y", "2.5"),
                   ("m", "5"), ("m.n", "1"), ("value", "3"), ("value.item", "4"), ("value.q", "1")}
    table = {r["path"]: r for r in I.schema_rows(rows).collect()}
    assert {p: table[p]["kind"] for p in ("a", "a.c", "l", "e", "o", "m", "id")} == {
        "a": "object", "a.c": "array", "l": "array", "e": "array", "o": "object", "m": "value", "id": "value"}
    assert table["id"]["is_primary"] and table["id"]["is_unique"] and table["a.b"]["sample"] == "t"


def test_too_deep_documents_are_an_error(spark):
    deep = "".join('{"k":' for _ in range(6)) + "1" + "}" * 6
    df = spark.createDataFrame([(0, deep)], "pos int, doc string")
    assert I.harvest_values(I.document_leaves(df, "doc", "pos", depth=6)).count() == 1
    with pytest.raises(Exception, match="nested deeper"):
        I.harvest_values(I.document_leaves(df, "doc", "pos", depth=4)).collect()


def test_documents_of_any_depth(spark):
    """Forty levels of objects and arrays are learned whole; flat corpora are unfolded as deep as they are."""
    deep = "".join('{"k%d":' % i if i % 3 else '[{"k%d":' % i for i in range(40)) + '"end"' + "".join("}" if i % 3 else "}]" for i in reversed(range(40)))
    df = spark.createDataFrame([(0, deep), (1, '{"a":"[[[[ \\" {{{{","b":[]}'), (2, "not [[[[[[[[[[[[[[[[[[[[[[[ json"), (3, None), (4, "")], "pos int, doc string")
    rows = I.document_leaves(df, "doc", "pos")
    paths = {r["path"]: r["value"] for r in I.harvest_values(rows).collect()}
    assert paths == {".".join(f"k{i}" for i in range(40)): "end", "a": '[[[[ " {{{{'}
    flat = spark.createDataFrame([(0, '{"a":{"b":1}}')], "pos int, doc string")
    assert I.deepest(flat, "doc") == 2 and I.deepest(df, "doc") == 40 + 14 and I.deepest(df.limit(0), "doc") == 0
    assert plan_of(I.document_leaves(flat, "doc", "pos")).split("Physical Plan")[1].count("Generate ") == 3


def test_typed_and_untyped_leaves_agree(spark):
    df = spark.createDataFrame([(0, ("p", [1, 2]), [("u", 1.0)]), (1, None, [])], "pos int, a struct<b:string,c:array<int>>, l array<struct<x:string,y:double>>")
    doc = df.select("pos", F.to_json(F.struct("a", "l")).alias("doc"))
    typed, untyped = I.harvest_values(I.leaves(df, "pos")), I.harvest_values(I.document_leaves(doc, "doc", "pos"))
    assert listed(typed, "path", "value") == listed(untyped, "path", "value")
    schema = I.to_schema(I.schema_rows(I.leaves(df, "pos")), "s")
    assert [f.kind for f in schema.root] == [OBJECT, ARRAY] and schema.leaf_paths() == ["a.b", "a.c.item", "l.x", "l.y"]


def test_learning_a_table(spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    schema, bank = learn(customers, "c_custkey", "customer")
    assert schema.leaf_paths() == ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    out = twin(customers, "c_custkey", "customer", 3)
    assert out.count() == 150 and dict(out.dtypes)["c_nationkey"] == "bigint" and dict(out.dtypes)["c_acctbal"] == "double"
    known = {r[0] for r in customers.select("c_mktsegment").distinct().collect()}
    assert sum(r[0] in known for r in out.select("c_mktsegment").collect()) > 50
    assert bank.where("key_name = 'c_mktsegment'").count() == len(known)


# -- reshape and text -------------------------------------------------------------------------------
NEST = "id int, n string, o struct<a:int,t:array<string>>, l array<struct<s:string,q:int>>"
DATA = [(1, 'x,"y"', (1, ["p", "q"]), [("s1", 1), ("s2", None)]), (2, None, None, []), (3, "<&>", (None, []), None)]


def test_flatten_and_render(spark):
    df = spark.createDataFrame(DATA, NEST)
    flat = R.flatten(df, as_text=True)
    assert flat.columns == ["id", "n", "o.a", "o.t", "l.0.s", "l.0.q", "l.1.s", "l.1.q"]
    assert tuple(flat.first()) == ("1", 'x,"y"', "1", '["p","q"]', "s1", "1", "s2", "")
    record, dtype = record_column(df.schema)
    first = df.select(json_text(record, dtype).alias("j"), xml_text(record, dtype, "r").alias("x"), csv_text(record, dtype).alias("c"),
                      render(record, dtype, "yaml").alias("y")).orderBy("j").collect()
    assert json.loads(first[0]["j"]) == {"id": 1, "n": 'x,"y"', "o": {"a": 1, "t": ["p", "q"]}, "l": [{"s": "s1", "q": 1}, {"s": "s2", "q": None}]}
    assert first[0]["j"] == json.dumps(json.loads(first[0]["j"]), indent=2)
    assert first[0]["c"] == 'id,n,o.a,o.t,l.0.s,l.0.q,l.1.s,l.1.q\n1,"x,""y""",1,"[""p"",""q""]",s1,1,s2,'
    assert "<t>\n      <t_0>p</t_0>\n      <t_1>q</t_1>\n    </t>" in first[0]["x"] and "<n>&lt;&amp;&gt;</n>" in first[2]["x"]
    assert "<q/>" in first[0]["x"] and "<n/>" in first[1]["x"] and "<l/>" in first[1]["x"]
    assert first[1]["j"] == '{\n  "id": 2,\n  "n": null,\n  "o": null,\n  "l": []\n}'
    assert first[0]["y"].startswith("id: 1\nn: x,\"y\"\n") and xml_tag("1 a") == "_1_a"


def test_headers_of_a_schema():
    schema = [Field("a"), Field("o", OBJECT, children=[Field("b")]), Field("t", ARRAY, children=[Field("item")]), Field("l", ARRAY, children=[Field("x"), Field("y")])]
    assert R.schema_headers(schema, slots=2) == ["a", "o.b", "t", "l.0.x", "l.0.y", "l.1.x", "l.1.y"]
    assert R.schema_headers(schema, nested_as_json=True) == ["a", "o", "t", "l"]


# -- files --------------------------------------------------------------------------------------------
def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id, name ,\n# note\n1,"x ""q"", y",z   \n2\n')
    got = S.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "name", "field"] and [tuple(r) for r in got.collect()] == [("1", 'x "q", y', "z"), ("2", "", "")]
    (tmp_path / "n.ndjson").write_text('{"a":1}\n{oops\n{"a":2}\n')
    assert listed(S.read_ndjson(spark, str(tmp_path / "n.ndjson"), "a int"), "a") == [(1,), (2,)]
    (tmp_path / "x.xml").write_text("<r><e k='1'><n>5</n></e><e k='2'>t</e></r>")
    assert S.read_xml(spark, str(tmp_path / "x.xml"), "e").count() == 2


def test_a_mixed_corpus(spark):
    files = [("a.json", '{\n "a": 1\n}'), ("b.jsonl", '{"a":1}\nbad\n{"a":2}'), ("c.yml", "- a: 1\n- a: 2\n"), ("d.xml", "<r a='1'><b>007</b><b>8</b></r>"),
             ("e.csv", 'a,b\n1,"x\ny"\n'), ("f.txt", "plain words"), ("g.xml", "<broken"), ("h.json", "{broken"), ("i.csv", "a,b\n")]
    docs = S.documents(spark.createDataFrame(files, "path string, content string")).collect()
    got = {}
    for r in sorted(docs, key=lambda r: (r["path"], r["record"])):
        got.setdefault(r["path"], []).append(json.loads(r["document"]) if r["error"] is None else "error")
    assert got == {"a.json": [{"a": 1}], "b.jsonl": [{"a": 1}, {"a": 2}], "c.yml": [{"a": 1}, {"a": 2}], "d.xml": [{"r": {"@_a": "1", "b": ["007", 8]}}],
                   "e.csv": [{"a": "1", "b": "x\ny"}], "f.txt": [{"content": "plain words"}], "g.xml": ["error"], "h.json": ["error"], "i.csv": [{"a": "", "b": ""}]}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", " lead", 'q"x'), ("2", "a\nb", ""), ("3", "c,d", "é")], "id string, a string, b string")
    W.write_csv(df, str(tmp_path / "c"))
    assert listed(S.read_csv(spark, str(tmp_path / "c")), "id", "a", "b") == listed(df, "id", "a", "b")


def test_sections(spark):
    df = spark.createDataFrame([(1, "x", [("s", 1)]), (2, "y", [("t", 2), ("u", 3)])], "id int, n string, l array<struct<id:string,q:int>>")
    text = "\n".join(r["line"] for r in W.entity_blocks(df, "id").orderBy("block", "seq", "at").collect())
    assert text == "# entity: root\nid,n\n1,x\n2,y\n\n# entity: l\nid,q\ns,1\nt,2\nu,3"
    keys = "\n".join(r["line"] for r in W.key_blocks(df.select("id", "n"), "id").orderBy("block", "seq", "at").collect())
    assert keys == "n\nx\ny"


def test_archive_writer_in_pieces_and_volumes(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("no"), F.concat(F.lit("n"), "id").alias("name"))
    pieces = A.multi_format_pieces(df, "no", [("a", "json"), ("b", "csv"), ("c", "yaml"), ("d", "xml")], "p.zip", "top", volume_records=4)
    done = A.write_archives(pieces, str(tmp_path), "zip").orderBy("archive").collect()
    assert [(r["archive"], r["entries"]) for r in done] == [("p.zip", 4), ("p_2.zip", 4), ("p_3.zip", 4)]
    assert sorted(os.listdir(tmp_path)) == ["p.zip", "p_2.zip", "p_3.zip"]
    with zipfile.ZipFile(tmp_path / "p_3.zip") as z:
        assert json.loads(z.read("top/a.json")) == [{"name": "n8"}, {"name": "n9"}] and z.read("top/b.csv") == b"name\nn8\nn9"
        assert z.read("top/c.yml") == b"- name: n8\n- name: n9\n" and z.read("top/d.xml").startswith(b"<root>\n  <record>\n    <name>n8</name>")
    split = A.split_pieces(df.where("no < 3"), "no", [(f"s{i}", "json") for i in range(4)], "s.tar")
    A.write_archives(split, str(tmp_path), "tar").collect()
    with tarfile.open(tmp_path / "s.tar") as t:
        assert [json.loads(t.extractfile(m).read()) for m in t.getmembers()] == [{"name": "n0"}, {"name": "n1"}, {"name": "n2"}, []]


def test_an_archive_of_any_size_is_one(spark, tmp_path):
    """Volumes come from the caller's arguments, not from the size of the input."""
    df = spark.range(4_000_005).select(F.col("id").alias("no"), F.lit("n").alias("name"))
    for pieces in (A.multi_format_pieces(df, "no", [("a", "csv"), ("b", "json")], "p.zip"), A.split_pieces(df, "no", [(f"s{i}", "xml") for i in range(4)], "p.zip")):
        assert [r[0] for r in pieces.select("archive").distinct().collect()] == ["p.zip"]
    entries = spark.range(100_001).select(F.lit("p.tar").alias("archive"), F.col("id").alias("entry_no"), F.concat(F.lit("e"), "id").alias("entry"),
                                          F.lit(0).alias("seq"), F.lit("x").alias("text"))
    assert [tuple(r)[:2] for r in A.write_archives(entries, str(tmp_path), "tar").collect()] == [("p.tar", 100_001)]


def test_nested_archives_stop_at_the_depth_limit(spark):
    data = A.pack([("x.json", b"{}")], "zip")
    for _ in range(9):
        data = A.pack([("in.zip", data)], "zip")
    out = AR.expand_archives(spark.createDataFrame([("a.zip", bytearray(data))], "path string, content binary"), max_depth=6).collect()
    assert [r["reason"] for r in out if r["kind"] == "skipped"] == ["nested too deep"] and sum(r["kind"] == "nested" for r in out) == 7


def test_entries_are_read_by_path(spark):
    data = A.pack([("Dir/a.txt", b"x" * (3 << 20)), ("b.txt", b"a\0b"), ("c.dat", b"y" * 70_000)], "tar.gz")
    files = spark.createDataFrame([("a.tgz", bytearray(data))], "path string, content binary")
    big = AR.read_entry(files, "dir/A.TXT", 2 << 20).first()
    assert big["truncated"] and len(big["content"]) == 2 << 20
    assert AR.read_entry(files, "b.txt").first()["binary"] and AR.read_entry(files, "c.dat").first()["binary"]
    assert AR.read_entry(files, "none").count() == 0


def test_one_file_per_record(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 2)], "id bigint, k string, v int")
    ctx = NameContext(df.schema, "s", "json", 2, 1)
    K.write_per_record(df, "id", str(tmp_path), Naming("d/{field:k}.{ext}"), ctx).collect()
    assert json.loads((tmp_path / "d/a_2.json").read_text()) == {"k": "a", "v": 2}


def files_below(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    content = F.when(F.col("id") == 19, F.raise_error(F.lit("lost")).cast("string")).otherwise("text")
    rows = spark.range(0, 20, 1, 2).select(F.concat("id", F.lit(".txt")).alias("path"), content.alias("content"))
    with pytest.raises(Exception, match="lost"):
        K.write_files(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or files_below(tmp_path / "out") == []


def test_files_are_moved_once_and_replace_what_was_there(spark, tmp_path):
    out = tmp_path / "out"
    (out / "d").mkdir(parents=True)
    (out / "d/1.txt").write_text("a longer text of an earlier run")
    rows = spark.range(0, 4, 1, 2).select(F.concat(F.lit("d/"), "id", F.lit(".txt")).alias("path"), F.col("id").cast("string").alias("content"))
    done = K.write_files(rows, str(out))
    assert listed(done, "path", "status", "bytes") == [(f"d/{i}.txt", "written", 1) for i in range(4)]
    assert files_below(out) == [f"d/{i}.txt" for i in range(4)] and (out / "d/1.txt").read_text() == "1"
    assert os.listdir(out) == ["d"]


def test_attempts_that_are_not_committed_leave_nothing(tmp_path):
    import pandas as pd
    staging, out = (tmp_path / "out/_staging").as_uri(), (tmp_path / "out").as_uri()
    rows = pd.DataFrame({"path": ["a", "b/c"], "content": ["x", b"\xff"]})
    lost, kept = (pd.concat(K._stage(iter([rows]), staging)) for _ in range(2))
    assert not set(lost["staged"]) & set(kept["staged"])
    for _ in range(2):
        assert [*pd.concat(K._place(iter([kept]), out))["bytes"]] == [1, 1]
    assert (tmp_path / "out/a").read_text() == "x" and (tmp_path / "out/b/c").read_bytes() == b"\xff"
    os.remove(tmp_path / "out/a")
    with pytest.raises(FileNotFoundError):
        list(K._place(iter([kept]), out))


def test_a_folder_is_listed_and_read_by_few_tasks(spark, tmp_path):
    folder = tmp_path / "all"
    names = [f"k={i % 3}/sub/{i}.txt" for i in range(300)] + ["a b+%20é.txt", "_x=1", "_metadata/m", "empty/none/none.bin"]
    for name in [*names, "_SUCCESS", ".hidden", "_gone/x.txt", ".crc/y", "part._COPYING_", "_common_metadata"]:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(name.encode() * (name != "empty/none/none.bin"))
    (folder / "bare").mkdir()
    wanted = sorted((n, len(n.encode()), n.encode()) if "none" not in n else (n, 0, b"") for n in names)
    for path in (str(folder), folder.as_uri() + "/"):
        got = S.read_folder(spark, path)
        assert [(p, n, bytes(c)) for p, n, c in listed(got, "path", "size", "content")] == wanted
        assert got.rdd.getNumPartitions() == 4
    by_spark = {(p, n, bytes(c)) for p, n, c in listed(S._read_by_spark(spark, str(folder)), "path", "size", "content")}
    assert {w for w in wanted if w[1] and "%" not in w[0]} < by_spark and len(by_spark) == len(wanted) - 1  # it decodes names
    assert S.read_folder(spark, str(folder / "bare")).count() == 0
    assert [bytes(r["content"]) for r in S.read_folder(spark, str(folder / "_x=1")).collect()] == [b"_x=1"]  # Spark's reader


def test_records_are_rendered_by_all_cores(spark):
    from synthmill.functions.ranks import row_index
    tasks = lambda df: df.select(F.spark_partition_id()).distinct().count()
    df = row_index(spark.range(0, 400, 1, 4).select("id", F.lit("n").alias("name")), "id", "no")
    assert tasks(A.multi_format_pieces(df, "no", [("c", "csv"), ("c", "json")], "p.zip")) == 8
    assert tasks(A.split_pieces(df, "no", [(f"b{i}", "xml") for i in range(2)], "p.tar")) == 8
    ctx = NameContext(df.drop("no").schema, "n", "xml", 0, 1)
    files = K.record_files(df.drop("no"), "id", Naming("{field:name}/x.{ext}"), ctx)
    assert tasks(files) == 4 and files.select("path").distinct().count() == 400


# -- packages -----------------------------------------------------------------------------------------
def test_package_round_trip(spark, tmp_path):
    inner = A.pack([("deep/v.xml", b"<r><id>5</id></r>")], "tar.gz")
    outer = A.pack([("a.json", b'{"id": 1, "n": "x y"}'), ("sub/in.tar.gz", inner)], "zip")
    got = P.import_packages(spark.createDataFrame([("p.zip", bytearray(outer))], "path string, content binary"))
    assert listed(got.members.where("kind = 'text'"), "path", "format") == [("a.json", "json"), ("sub/in/deep/v.xml", "xml")]
    assert listed(P.member_leaves(got.schemas), "member", "path") == [("a.json", "id"), ("a.json", "n"), ("sub/in/deep/v.xml", "r.id")]
    nested = [P.NestedArchive(r["folder_path"], r["archive_path"], r["archive_format"]) for r in P.nested_map(got.members).collect()]
    members = [P.Member(r["path"], I.to_schema(got.schemas.where(F.col("member") == r["path"]), r["path"]), r["format"])
               for r in got.members.where("kind = 'text'").collect()]
    made = P.variant_rows(spark, members, 5, 3, modes={"a.json": {"id": "unique"}}, default="same")
    assert "Exchange" not in executed_plan(P.repack(made, "p", "zip", nested))
    P.write_variants(made, str(tmp_path), "p", "zip", nested).collect()
    ids = set()
    for i in range(1, 6):
        with zipfile.ZipFile(tmp_path / f"p_000{i}.zip") as z:
            ids.add(json.loads(z.read("a.json"))["id"])
            assert json.loads(z.read("a.json"))["n"] == "x y"
            with tarfile.open(fileobj=io.BytesIO(z.read("sub/in.tar.gz"))) as t:
                assert t.getnames() == ["deep/v.xml"]
    assert len(ids) == 5
    folder = P.repack(made, "p", "folder").collect()
    assert len(folder) == 10 and folder[0]["path"].startswith("p_000")


def test_a_folder_is_one_package(spark, tmp_path):
    (tmp_path / "f/sub").mkdir(parents=True)
    (tmp_path / "f/a b.csv").write_text("k\n1\n")
    (tmp_path / "f/sub/in.zip").write_bytes(A.pack([("n.json", b'{"z":1}')], "zip"))
    got = P.import_packages(S.read_folder(spark, str(tmp_path / "f")), package="f")
    assert listed(got.members, "package", "path", "kind") == [
        ("f", "a b.csv", "text"), ("f", "sub/in", "nested_archive_folder"), ("f", "sub/in/n.json", "text")]
    assert listed(got.values, "member", "path", "value") == [("a b.csv", "k", "1"), ("sub/in/n.json", "z", "1")]
    full = P.hydrate(got.members, got.schemas).where("kind = 'text'")
    assert {r["path"]: [x["path"] for x in r["schema_rows"]] for r in full.collect()} == {"a b.csv": ["k"], "sub/in/n.json": ["z"]}


def test_snapshot_is_the_exact_newest_part(spark):
    bank = bank_of(spark, [("a", "k", str(i)) for i in range(60)]).withColumn(
        "last_used_at", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=F.call_function("div", F.col("value").cast("long"), F.lit(7)).cast("int")))
    names = spark.createDataFrame([], "id string, name string")
    got = listed(B.snapshot(bank, names, 20), "id")
    want = listed(bank.orderBy(F.desc("last_used_at"), F.desc("id")).limit(20), "id")
    assert got == want and B.snapshot(bank, names, 1000).count() == 60


# -- manifests and streams ----------------------------------------------------------------------------
def test_manifests(spark):
    assert manifest_path("out/foo.json") == "out/foo.manifest.json" and manifest_path("foo") == "foo.manifest.json"
    texts = ['{"seed":-1,"recordCount":2.7,"schemaHash":"h"}', '{"seed":1,"recordCount":0,"schemaHash":"h"}', "{", '{"seed":true}']
    out = parse_manifests(spark.createDataFrame(list(enumerate(texts)), "i int, content string")).orderBy("i").collect()
    assert [r["problem"] for r in out] == [None, "no valid record count", "not a JSON object", "no numeric seed"]
    assert (out[0]["seed"], out[0]["record_count"]) == (2 ** 32 - 1, 2)


def test_a_repeated_batch_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "k", "x")] * 3, "category string, key_name string, value string")
    merge = bank_merger(str(tmp_path / "bank"), now())
    for batch in (0, 1, 1, 0, 1):
        merge(rows, batch)
    assert listed(read_bank(spark, str(tmp_path / "bank")), "value", "use_count") == [("x", 6)]


def test_stream_rows_equal_batch_rows(spark, tmp_path):
    schema = Schema("s", [Field("a", sample="ab 12"), Field("d", sample="2024-01-01")])
    stream = J.generate_stream(spark, schema, 5, 50)
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "o"))
    try:
        for _ in range(20):
            q.processAllAvailable()
            if os.path.isdir(tmp_path / "o") and spark.read.schema("row bigint").parquet(str(tmp_path / "o")).count() > 20:
                break
    finally:
        q.stop()
    got = spark.read.parquet(str(tmp_path / "o")).select("row", "a", "d")
    n = got.count()
    want = spark.range(n).select(F.col("id").alias("row"), *SchemaPlan(schema, 5).columns(F.col("id")))
    assert n > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_pair_is_new_once_however_late_it_comes(spark, tmp_path):
    """A second run of the stream, with rows from years before, adds only what has never been seen."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows, n):
        spark.createDataFrame(rows, "path string, value string, used_at timestamp").coalesce(1).write.parquet(f"{source}/{n}")
        stream = spark.readStream.schema("path string, value string, used_at timestamp").option("recursiveFileLookup", True).parquet(source)
        J.first_seen_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(
            availableNow=True).start(out).awaitTermination()
        return sorted((r.path, r.value) for r in spark.read.parquet(out).collect())
    assert run([("a", "1", datetime(2024, 1, 1)), ("a", "1", datetime(2024, 1, 2))], 1) == [("a", "1")]
    assert run([("a", "2", datetime(1990, 1, 1)), ("a", "1", datetime(1980, 1, 1)), ("a", "2", datetime(2030, 1, 1))], 2) == [("a", "1"), ("a", "2")]


def test_framed_lines_of_many_batches(spark, tmp_path):
    """Commas after all but the last record of a part, also where parts are empty or batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        W.write_json(spark.range(0, 20, 1, 3).where("id < 10"), str(tmp_path / "j"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts = [json.loads(f.read_text()) for f in (tmp_path / "j").glob("part*")]
    assert sorted(r["id"] for p in parts for r in p) == list(range(10))


@pytest.mark.parametrize("depth", [3, 40, 100_000])
def test_deep_pages(spark, monkeypatch, depth):
    """Any page is the same part of the sorted bank, whatever range it is looked for in."""
    monkeypatch.setattr(B, "PAGE_DEPTH", depth)
    rows = [("c", "k", f"v{i}", datetime(2024, 1, 1 + i % 3, 0, 0, i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "category string, key_name string, value string, used_at timestamp_ntz")
    bank = B.record_use(empty_bank(spark), df, now()).cache()
    names = spark.createDataFrame([], "id string, name string, source_key string, created_at timestamp_ntz")
    whole = [r["id"] for r in sorted(bank.collect(), key=lambda r: (r["last_used_at"], r["id"]), reverse=True)]
    for offset, limit in ((0, 5), (7, 50), (39, 2), (118, 10), (120, 5), (500, 5)):
        items, total = B.page(bank, names, offset, limit)
        assert [r["id"] for r in items.collect()] == whole[offset:offset + limit] and total.first()[0] == 120
    some = [i for i in whole if {r["id"]: r["value"] for r in bank.collect()}[i].startswith("v1")]
    assert [r["id"] for r in B.page(bank, names, 20, 9, "V1")[0].collect()] == some[20:29]


class Steps:
    """Stands in for a frame and keeps the function of its Arrow step."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def arrow_rows(names, rows):
    import pyarrow as pa
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])


def test_yaml_lists_are_read_item_by_item():
    import yaml
    items = S._parse("yaml", "- a: 1\n- [")
    assert next(items) == {"a": 1}
    with pytest.raises(yaml.YAMLError):
        list(items)
    texts = ["", "# c\n", "a: 1", "- &x {a: 1}\n- *x\n- [*x, *x]\n", "&l\n- 1\n", "!!set {a, b}", "!!omap\n- a: 1\n", "- 'a\n- b'\n- c", "[1, {b: 2020-01-01}]"]
    assert [list(S._parse("yaml", t)) for t in texts] == [v if isinstance(v, list) else [v] for v in map(yaml.safe_load, texts)]
    rows = [("b", "yaml", "- a: 1\n- ["), ("g", "yaml", "- a: 1\n- \"b\\nc\""), ("d", "yaml", "- a\n---\n- b\n"), ("c", "csv", "u\n"), ("e", "csv", "")]
    out = [tuple(r.values()) for b in S._to_documents(iter([arrow_rows(["path", "format", "content"], rows)])) for r in b.to_pylist()]
    assert out == [("b", 0, None, "ParserError"), ("g", 0, '{"a": 1}', None), ("g", 1, '"b\\nc"', None), ("d", 0, None, "ComposerError"),
                   ("c", 0, '{"u": ""}', None)]


@pytest.mark.parametrize("text", ["- id: 2\n  name: 'O'Neil'\n- id: 3\n", "- id: 2\n---\n- id: 3\n", "- id: 2\n- [", "- id: 2\n- ? [1, 2]\n  : 3\n",
                                  "just words", "- id: 2\n- 5\n", "- [id, 2]\n"])
def test_a_yaml_file_that_cannot_be_read_fails_by_name(spark, tmp_path, text):
    (tmp_path / "good.yaml").write_text("- id: 1\n  name: a\n-\n")
    assert sorted(map(tuple, S.read_yaml(spark, str(tmp_path), "id bigint, name string").collect()), key=str) == [(1, "a"), (None, None)]
    (tmp_path / "bad.yaml").write_text(text)
    with pytest.raises(Exception, match="unreadable YAML file .*bad.yaml"):
        S.read_yaml(spark, str(tmp_path), "id bigint, name string").collect()


def test_a_task_without_disk_or_parser_does_not_take_the_file_for_unreadable(monkeypatch):
    def full(**_):
        raise OSError("no space left on device")
    assert list(S._file_records("p", "yaml", "a: [")) == [("p", 0, None, "ParserError")]
    monkeypatch.setattr(S, "HELD", 1)
    monkeypatch.setattr("tempfile.TemporaryFile", full)
    with pytest.raises(OSError, match="no space"):
        list(S._file_records("p", "yaml", "a: 1"))
    monkeypatch.setitem(sys.modules, "yaml", None)
    with pytest.raises(ImportError):
        list(S._file_records("p", "yaml", "a: 1"))


def test_customers_of_any_text_pass_through_yaml(spark, tmp_path):
    import __spark_entry__ as contract
    import duckdb
    odd = ["O'Neil", 'x\\y "q" é😀', "a: b", "# c", "- d", "l1\nl2\r\n", " pad ", "", "yes", "007", "~", "d\x7f\x85\u2028\u2029\ufeff\ufffe\x07\0", None]
    rows = [(i, t, i, 1.0, u) for i, (t, u) in enumerate(zip(odd, odd[::-1], strict=True))] + [(None, "n", None, None, "s")]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(
        f"{tmp_path}/customer.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        want = con.execute(contract.oracle_sql()["s5_read_yaml"]).fetchall()
    got = contract.queries()["s5_read_yaml"](spark, str(tmp_path)).select("id", "name", "segment", "note").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len(got) == len(rows)


def test_archives_share_output_batches_of_bounded_size():
    entry = b"x" * (1 << 20)
    small = [(f"p{i}.tar", A.pack([("a.json", b"{}"), ("b.csv", b"k")], "tar")) for i in range(300)]
    large = [(f"q{i}.tar", A.pack([("a.json", entry)] * 3, "tar")) for i in range(8)]
    for step, rows in ((AR.expand_archives(Steps()), 2), (AR._listing(Steps()), 2), (AR._listing(Steps(), "a.json"), 1)):
        batches = list(step.run(iter([arrow_rows(["path", "content"], small)])))
        assert [b.num_rows for b in batches] == [300 * rows]
    batches = list(AR.expand_archives(Steps()).run(iter([arrow_rows(["path", "content"], large)])))
    assert sum(b.num_rows for b in batches) == 24 and max(b.nbytes for b in batches) < 6 << 20


def test_tar_headers_are_those_of_tarfile():
    for name in ("a", "Sub/in.tgz", "x" * 100, "x" * 101, "é", "", "q/" * 60):
        for size in (0, 511, 8 ** 11 - 1, 8 ** 11):
            info = tarfile.TarInfo(name)
            info.size = size
            assert A.tar_header(name, size) == info.tobuf(tarfile.PAX_FORMAT)


def test_repacked_variants_share_output_batches(spark):
    made = Steps()
    step = P.repack(made, "pkg", "tar", [P.NestedArchive("in", "in.zip", "zip")])
    rows = [(f"pkg_{i}", [{"path": "in/a.json", "content": "{}"}, {"path": "b.json", "content": "[]"}]) for i in range(200)]
    assert [b.num_rows for b in step.run(iter([arrow_rows(["label", "files"], rows)]))] == [200]


def test_an_import_parses_its_members_once_and_hydrates_without_broadcast(spark):
    data = A.pack([("a.json", b'{"k": 1}'), ("b.csv", b"u,t\n1,2\n")], "zip")
    got = P.import_packages(spark.createDataFrame([("p.zip", bytearray(data))], "path string, content binary"))
    for part in (got.schemas, got.values, got.skipped, got.members):
        assert "MapIn" not in plan_of(part)
    full = P.hydrate(got.members, got.schemas)
    assert "Broadcast" not in executed_plan(full)
    assert sorted((r["path"], len(r["schema_rows"])) for r in full.collect()) == [("a.json", 1), ("b.csv", 2)]


def test_coerced_text_makes_each_test_once(spark):
    from synthmill.functions import kinds
    odd = {"-0": "0", "007": "7", "-007": "-7", "0" * 40 + "12": "12", "9007199254740991": "9007199254740991", "9007199254740992": "9007199254740992",
           " 5\n": "5", " 1.5 ": "1.5", "true ": "true", " null ": None, " ": "", " x ": " x ", "-": "-", "--1": "--1", None: None}
    df = spark.createDataFrame([(v,) for v in odd], "v string").select("v", kinds.coerced_text(F.col("v")).alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == odd
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 2


def test_tasks_of_a_table_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    from synthmill.plans import registry
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    monkeypatch.setattr(registry, "ROWS", 50, raising=False)
    df = registry.table(spark, str(tmp_path), "t")
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) <= 100 and sum(sizes) == 1000
    assert sorted(r["id"] for r in df.collect()) == list(range(1000))
    monkeypatch.setattr(registry, "ROWS", 10_000)
    assert registry.table(spark, str(tmp_path), "t").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_tar_entries_are_those_tarfile_reads():
    names = ["a.json", "d/b.csv", "x" * 100, "y" * 101 + ".txt", "é.json", "p/" * 70 + "q.json"]
    sizes = [0, 1, 511, 512, 513, 8192, 8193, 70_000]
    for mode, fmt in (("w", "tar"), ("w:gz", "tar.gz")):
        for form in (tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT):
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode=mode, format=form) as t:
                for i, (name, size) in enumerate((n, s) for n in names for s in sizes if form != tarfile.USTAR_FORMAT or n[0] != "y"):
                    info = tarfile.TarInfo(name)
                    info.size, info.mtime, info.uname = size, 5, "u"
                    t.addfile(info, io.BytesIO(bytes([i]) * size))
                folder = tarfile.TarInfo("dir")
                folder.type = tarfile.DIRTYPE
                t.addfile(folder)
            data = out.getvalue()
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                want = [(m.name, m.size, m.isdir(), t.extractfile(m).read() if m.isfile() else None) for m in t]
            got = [(n, s, d, None if d else read()) for n, s, d, read in AR.iter_entries(data, fmt)]
            assert got == want
    plain = bytearray(A.pack([("a.json", b"{}"), ("b.json", b"x" * 600)], "tar"))
    with pytest.raises(tarfile.ReadError):
        [read() for *_, read in AR.iter_entries(bytes(plain[:1536 + 100]), "tar")]
    plain[3] ^= 1
    with pytest.raises(tarfile.ReadError):
        list(AR.iter_entries(bytes(plain), "tar"))
    headers = []
    entries = AR.iter_entries(A.pack([(f"{i}.json", b"") for i in range(50)], "tar"), "tar")
    for _ in entries:
        headers.append(len(entries.gi_frame.f_locals["t"].members))
    assert max(headers) <= 1
