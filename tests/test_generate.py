import re

import pytest
from pyspark.sql import functions as F

from synthmill.functions import draws
from synthmill.functions.kinds import detect
from synthmill.functions.permute import capacity_of, permute
from synthmill.operators import infer
from synthmill.operators.generate import generate, generate_for, generation_counts
from synthmill.operators.bank import bank_for_fields
from synthmill.operators.leaves import BANK_JOINED, BANK_LITERAL, CLOSED_SET, DISTINCT, FREE, TEMPLATE, TIED, USED_UP, epoch_ms
from synthmill.operators.pools import pools
from synthmill.operators.report import build_manifest, replay_arguments
from synthmill.schema import ARRAY, OBJECT, Field, Schema
from tests.conftest import executed_plan

# Starter schemas of the usual kinds: flat table, nested order, invoice.
FLAT = Schema("flat", [Field("customer_id", sample="1001", is_primary=True, is_unique=True), Field("full_name", sample="Sam Poe"),
                       Field("email", sample="sam.poe@example.com"), Field("signup_date", sample="2024-06-15"), Field("balance", sample="19.99")])
ORDER = Schema("order", [
    Field("order_id", sample="ORD-10042", is_primary=True, is_unique=True), Field("order_date", sample="2024-03-01"),
    Field("customer", OBJECT, children=[Field("id", sample="C-88", is_primary=True), Field("name", sample="Blue Barn")]),
    Field("items", ARRAY, children=[Field("sku", sample="SKU-100", is_unique=True), Field("qty", sample="2"), Field("price", sample="12.50"),
                                    Field("tags", ARRAY, children=[Field("item", sample="red", is_unique=True)])]),
    Field("total", sample="25.00", null_rate=30)])
INVOICE = Schema("invoice", [Field("no", sample="INV-2024-001"), Field("day", sample="03/15/2024"),
                             Field("lines", ARRAY, children=[Field("text", sample="Repair hours"), Field("amount", sample="$1,200.00")])])

SOURCES = (CLOSED_SET, BANK_LITERAL, BANK_JOINED, TEMPLATE, FREE, DISTINCT, USED_UP, TIED)


def rows(df):
    return sorted(df.collect(), key=str)


@pytest.mark.parametrize("schema", [FLAT, ORDER, INVOICE], ids=lambda s: s.name)
def test_partitioning_does_not_change_the_result(spark, schema):
    def run(parts):
        return rows(generate_for(spark.range(0, 300, 1, parts), "id", schema, 5, keep=["id"]))
    assert run(1) == run(7) == run(64)


def test_single_rows_can_be_replayed(spark):
    whole = {r["id"]: r for r in generate_for(spark.range(200), "id", ORDER, 5, keep=["id"]).collect()}
    some = generate_for(spark.range(50, 60), "id", ORDER, 5, keep=["id"]).collect()
    assert all(whole[r["id"]] == r for r in some)


def test_seed_changes_the_result(spark):
    assert rows(generate(spark, FLAT, 20, 1)) != rows(generate(spark, FLAT, 20, 2))


def test_unique_over_rows_and_levels(spark):
    df = generate(spark, ORDER, 3000, 9)
    assert df.select("order_id").distinct().count() == 3000
    # "C-88" has 2600 values of its shape; the wider alphabet is used for 3000 rows.
    assert df.select("customer.id").distinct().count() == 3000
    skus = df.select(F.explode("items.sku"))
    assert skus.count() == skus.distinct().count()
    tags = df.select(F.explode(F.flatten("items.tags")))
    assert tags.count() == tags.distinct().count()


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 260, 2 ** 31 - 1, 2 ** 31 + 5, 26 ** 3 * 10 ** 12])
def test_permutation_is_a_bijection(spark, size):
    n = min(size, 5000)
    out = spark.range(n).select(permute(F.col("id"), size, 3, "p").alias("v"))
    stats = out.agg(F.countDistinct("v"), F.min("v"), F.max("v")).first()
    assert stats[0] == n and stats[1] >= 0 and stats[2] < capacity_of(size) <= size


@pytest.mark.parametrize("sample, shape", [
    ("true", r"^(true|false)$"), ("1001", r"^[0-9]+$"), ("00042", r"^0[0-9]{4}$"), ("19.99", r"^-?[0-9]+\.[0-9]{1,2}$"),
    ("$1,200.00", r"^\$[0-9,]+\.[0-9]{2}$"), ("€5.10", r"^-?€[0-9]+\.[0-9]{2}$"), ("45.5%", r"^-?[0-9]+\.[0-9]%$"),
    ("2024-06-15", r"^20[0-9]{2}-[01][0-9]-[0-3][0-9]$"), ("2024-06-15T01:02:03Z", r"^20.*T[0-2][0-9]:[0-5][0-9]:[0-5][0-9]\.[0-9]{3}Z$"),
    ("06/15/2024", r"^[01][0-9]/[0-3][0-9]/20[0-9]{2}$"), ("15/06/2024", r"^[0-3][0-9]/[01][0-9]/20[0-9]{2}$"),
    ("2024/06/15", r"^20[0-9]{2}/[01][0-9]/[0-3][0-9]$"), ("a.b@c.io", r"^[^\s@]+@[^\s@]+\.[^\s@]+$"),
    ("89375b00-0000-4000-8000-00000000abcd", r"^[0-9a-z-]{36}$"), ("(555) 010-1234", r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$"),
    ("Seattle", r"^[A-Za-z]{7}$"), ("INV-1", r"^[A-Za-z0-9-]{5}$"), ("Two words!", r"^[A-Z][a-z]{2} [a-z]{5}!$")])
def test_values_keep_the_format_of_the_sample(spark, sample, shape):
    values = [r[0] for r in generate(spark, Schema("s", [Field("v", sample=sample)]), 300, 4).collect()]
    texts = [str(v).lower() if isinstance(v, bool) else str(v) for v in values]
    assert [t for t in texts if not re.search(shape, t)] == []
    assert len(set(texts)) > 1


def test_constraints(spark):
    schema = Schema("s", [Field("rate", sample="5", null_rate=30), Field("clamped", sample="100", min=95, max=105), Field("cut", sample="Some words", max_length=4),
                          Field("padded", sample="ab c", min_length=7), Field("rx", sample="AB12", pattern="^[A-M]"), Field("enum", enum=["a", " ", "b "]),
                          Field("bad_rx", sample="AB12", pattern="[")])
    out = generate(spark, schema, 4000, 8).collect()
    nulls = sum(r["rate"] is None for r in out)
    assert abs(nulls / 4000 - .3) < 3 * (.3 * .7 / 4000) ** .5
    assert all(95 <= r["clamped"] <= 105 for r in out)
    assert all(len(r["cut"]) == 4 and len(r["padded"]) == 7 and r["padded"].endswith("xxx") for r in out)
    assert all(re.search("^[A-M]", r["rx"]) for r in out) and {r["enum"] for r in out} == {"a", "b"}


def test_numbers_are_clamped_without_losing_their_format(spark):
    """Commas are part of the number and the percent sign and padding survive a bound."""
    schema = Schema("s", [Field("a", sample="$1,200.00", max=1000), Field("b", sample="45.5%", max=40), Field("c", sample="00042", max=40)])
    r = generate(spark, schema, 200, 3).collect()
    assert {x["a"] for x in r} >= {"$1,000.00"} and all(x["a"].startswith("$") for x in r)
    assert all(x["b"].endswith("%") for x in r) and all(len(x["c"]) == 5 for x in r)


def test_bank_values_are_used_half_the_time_and_only_where_they_fit(spark):
    schema = Schema("s", [Field("name", sample="Ann Lee"), Field("qty", sample="5")])
    bank = {"NAME": ["Kim Roe", "Bo Dia"], "qty": ["7", "many"]}
    out = generate(spark, schema, 3000, 2, bank=bank).collect()
    share = sum(r["name"] in bank["NAME"] for r in out) / 3000
    assert .45 < share < .56
    assert all(isinstance(r["qty"], int) for r in out)
    # Without a bank the result depends on schema and seed alone.
    assert rows(generate(spark, schema, 50, 2)) == rows(generate(spark, schema, 50, 2, bank={}))


def test_many_shapes_are_mutated_in_place(spark):
    pool = [f"{'a' * (i + 1)}-{i}!" for i in range(30)]
    out = generate(spark, Schema("s", [Field("v", sample="x y!")]), 500, 2, bank={"v": pool}).collect()
    assert all(re.fullmatch(r"[a-z]+-[0-9]+!|[a-z] [a-z]!", r["v"]) for r in out)


def test_exhaustion_is_counted(spark):
    schema = Schema("s", [Field("v", sample="K 1", is_unique=True), Field("e", enum=["x", "y"], is_unique=True), Field("b", sample="true", is_unique=True)])
    made = [r["v"] for r in generate_for(spark.range(300), "id", schema, 3).collect()]
    assert len(set(made[:260])) == 260 and all(re.fullmatch(r"[a-z]{6}_[0-9]+", v) for v in made[260:])
    counts = generation_counts(spark.range(300), "id", schema, 3).first()
    assert counts["distinct_used_up"] == 40 + 298 + 298
    assert counts["leaves_made"] == 900 and counts["from_closed_set"] == 2 and counts["drawn_distinct"] == 260 + 2


def test_report_adds_up(spark):
    c = generation_counts(spark.range(500), "id", ORDER, 5).first()
    used = sum(c[name] for name in SOURCES)
    assert used == c["leaves_made"] - c["left_blank"] and c["left_blank"] > 0


def test_replay_from_a_manifest(spark):
    report = generation_counts(spark.range(40), "id", FLAT, 77)
    text = build_manifest(report, FLAT, seed=77, record_count=40, ci_mode=True, fmt="csv", created_at="2024-01-01T00:00:00Z").first()[0]
    assert rows(generate(spark, FLAT, **replay_arguments(text))) == rows(generate(spark, FLAT, 40, 77))


def test_generation_does_not_shuffle(spark):
    plan = executed_plan(generate(spark, ORDER, 1000, 5))
    assert "Exchange" not in plan and "Python" not in plan


def test_ties_and_modes(spark):
    schema = Schema("s", [Field("a", sample="9"), Field("b"), Field("o", OBJECT, children=[Field("c", sample="null")])], tied_paths=["A", "b", "o.c"])
    out = generate(spark, schema, 30, 6).collect()
    assert {r["a"] for r in out} == {9} and len({r["b"] for r in out}) == 1 and {r["o"]["c"] for r in out} == {None}
    moded = FLAT.with_modes({"full_name": "same", "email": "unique"})
    assert moded.tied_paths == ("full_name",)
    assert [f.unique for f in moded.root] == [False, False, True, False, False]


def test_trees_reject_repeated_keys_and_trim_names():
    with pytest.raises(ValueError):
        Schema("s", [Field("a"), Field(" a ")])
    assert Field(" ").name == "field"
    assert Schema.from_json(ORDER.to_json()) == ORDER and Schema.from_json(ORDER.to_json()).hash() == ORDER.hash()


def test_key_rules():
    assert Field("name", pool=" people ").write_key("a.name") == "pool:people"
    assert Field("name", override="Person").write_key("a.name") == "Person/a.name"
    assert Field("name", override="NAME").write_key("a.name") == "a.name"
    assert Field("name", source_keys=["A.NAME", "b.name", " "]).read_keys("a.name") == ["a.name", "b.name"]


SAMPLES = ["true", "12", "0012", "-007", "1.50", "$5", "$1,200.00", "1,200", "€3.1", "12%", "1.5%", "2024-01-02", "2024-01-02T03:04:05Z", "01/02/2024",
           "13/02/2024", "02/13/2024", "2024/01/02", "a@b.co", "89375b00-0000-4000-8000-00000000abcd", "(555) 010-1234", "1234567", "abc", "a_b-1", "a b", "x,y", "-", "5."]


@pytest.mark.parametrize("order", ["intent", "reference"])
def test_both_forms_of_kind_detection_agree(spark, order):
    pools = {f"{i}": [s] for i, s in enumerate(SAMPLES)}
    pools |= {f"p{i}": [SAMPLES[i], SAMPLES[i + 1]] for i in range(len(SAMPLES) - 1)}
    data = [(k, v) for k, vs in pools.items() for v in vs]
    values = spark.createDataFrame(data, "path string, value string")
    plain = {r["path"]: r for r in infer.detect_kinds(values, order=order).collect()}
    samples = spark.createDataFrame([(k, v[0]) for k, v in pools.items()], "path string, sample string")
    sampled = {r["path"]: r for r in infer.detect_kinds(values, samples, order=order).collect()}
    for path, pool in pools.items():
        for got, sample in ((plain[path], None), (sampled[path], pool[0])):
            want = detect(pool, sample, order)
            assert got["kind"] == want.kind, (pool, sample)
            if want.kind == "int-padded":
                assert got["pad_width"] == want.pad_width
            if want.kind in ("float", "percent", "currency"):
                assert (got["decimals"], float(got["min_num"]), float(got["max_num"])) == (want.decimals, float(want.low), float(want.high)), pool
            if want.kind == "currency":
                assert got["thousands"] == want.thousands


def test_order_of_number_kinds():
    assert [detect([], s).kind for s in ("1001", "0042", "19.99", "$5")] == ["int", "int-padded", "float", "currency"]
    assert [detect([], s, "reference").kind for s in ("1001", "0042", "19.99")] == ["currency"] * 3


def test_draw_hash_is_stable(spark):
    key = draws.draw_key(1, "a", "b")
    assert key == draws.draw_key(1, "a", "b") and 1_700_000_000_000 <= epoch_ms(2 ** 32 + 5) == epoch_ms(5)
    bits = spark.range(20000).select(draws.draw(key, F.col("id")).alias("b"))
    share = bits.select(F.avg(draws.chance(F.col("b"), .25).cast("int"))).first()[0]
    assert abs(share - .25) < .02


def test_rows_do_not_depend_on_their_number(spark):
    schema = Schema("s", [
        Field("code", sample="ab12", is_unique=True), Field("order", sample="ORD-10042", is_unique=True),
        Field("starts", sample="AB12", is_unique=True, pattern="^[AB]"), Field("many"),
        Field("one", sample="AB 123", is_unique=True, pool="p"), Field("two", sample="AB 123", is_unique=True, pool="p")])
    bank = {"many": ["Ab " + "1" * i for i in range(1, 15)]}
    head = rows(generate(spark, schema, 100, 3, bank=bank))
    assert rows(generate(spark, schema, 3000, 3, bank=bank).limit(100)) == head
    far = generate_for(spark.range(100), "id", schema, 3, bank=bank)
    assert rows(far) == head


def test_a_unique_leaf_tries_for_its_pattern_at_any_size(spark):
    schema = Schema("s", [Field("v", sample="ABC1234567", is_unique=True, pattern="^[A-C]")])
    made = [r.v for r in generate(spark, schema, 2000, 5).collect()]
    assert len(set(made)) == 2000
    assert sum(v[0] in "ABC" for v in made) > 1300


def test_pooled_unique_leaves_never_repeat_each_other(spark):
    fields = [Field(n, sample="AB 123", is_unique=True, pool="p") for n in ("a", "b", "c")]
    for seed in (1, 9):
        made = generate(spark, Schema("s", fields), 50_000, seed).collect()
        assert len({v for r in made for v in r}) == 150_000


def test_templates_read_at_run_time_give_the_same_values(spark, monkeypatch):
    from synthmill.operators import leaves
    schema = Schema("s", [Field("v")])
    bank = {"v": ["Ab 12", "cd-345 Xyz", "é 7", "0123456789012345678901234567890", "abcdefghijklmnopqrstuvwxyz"]}
    spelled = rows(generate(spark, schema, 500, 4, bank=bank))
    monkeypatch.setattr(leaves, "MAX_SHAPES", 0)
    assert rows(generate(spark, schema, 500, 4, bank=bank)) == spelled


def test_stream_of_unique_rows_equals_the_batch(spark, tmp_path):
    from synthmill.streaming.jobs import generate_stream
    schema = Schema("s", [Field("code", sample="ab12", is_unique=True), Field("starts", sample="AB12", is_unique=True, pattern="^[AB]")])
    spark.range(300).write.parquet(str(tmp_path / "ids"))
    ids = spark.readStream.schema("id long").parquet(str(tmp_path / "ids"))
    out = generate_stream(spark, schema, 8, rows=ids, row="id", keep=())
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("row").drop("row")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in generate(spark, schema, 300, 8).collect()]


# -- values of a bank, however many -----------------------------------------------------------------
def test_large_pools_are_drawn_whole(spark):
    """Ranges and values come from all of a bank, and joined values give the same records as literals."""
    from synthmill.operators import infer as I
    from synthmill.plans.learn import learn
    df = spark.range(1200).select("id", F.concat(F.lit("N-"), "id").alias("name"), (F.col("id") * 7.25 - 900).alias("amount"),
                                  F.array(F.struct(F.concat(F.lit("t"), "id", F.lit("@x.org")).alias("mail"), F.hex("id").alias("code"))).alias("l"))
    schema, bank = learn(df, "id", "s")
    bank = bank.cache()
    few, many = pools(bank, schema, literals=10 ** 6), pools(bank, schema)
    assert not few.many and not many.few and [many.many[p].size for p in ("name", "amount", "l.mail", "l.code")] == [1200, 1200, 1200, 500]

    def run(**given):
        return rows(generate_for(spark.range(3000), "id", schema, 5, keep=["id"], **given))
    whole = run(pools=many)
    assert whole == run(pools=few) == run(bank=bank_for_fields(bank, schema, 10 ** 6))
    assert max(r["amount"] for r in whole) > 7000 and len({r["name"] for r in whole}) > 700


def test_large_pools_in_arrays_patterns_counters_and_streams(spark, tmp_path):
    """Joined values give what literal ones give, wherever they are drawn, with the same counters, observed or not."""
    from pyspark.sql import Observation

    from synthmill.operators.generate import observed_counts
    from synthmill.streaming.jobs import generate_stream
    df = spark.range(900).select("id", F.concat(F.lit("N-"), "id").alias("name"), (F.col("id") * 3 - 500).alias("amount"),
                                 F.array(F.struct(F.concat(F.lit("t"), "id", F.lit("@x.org")).alias("mail"))).alias("l"))
    from synthmill.plans.learn import learn
    schema, bank = learn(df, "id", "s")
    name, amount, listed = schema.root
    import dataclasses
    schema = Schema("s", [dataclasses.replace(name, pattern="[37]$", null_rate=10), dataclasses.replace(amount, max=400), listed], tied_paths=["none"])
    few, many = pools(bank, schema, literals=10 ** 6), pools(bank, schema)
    assert len(many.many) == 3 and not few.many
    whole = rows(generate(spark, schema, 400, 5, pools=many))
    assert whole == rows(generate(spark, schema, 400, 5, pools=few))
    one, two = (generation_counts(spark.range(400), "id", schema, 5, pools=p).first().asDict() for p in (few, many))
    assert one.pop(BANK_LITERAL) == two.pop(BANK_JOINED) > 300 and one.pop(BANK_JOINED) == two.pop(BANK_LITERAL) == 0 and one == two
    seen = Observation()
    generate_for(spark.range(400), "id", schema, 5, pools=many, observed=seen).write.parquet(str(tmp_path / "made"))
    counts = observed_counts(spark, seen).first().asDict()
    assert counts == generation_counts(spark.range(400), "id", schema, 5, pools=many).first().asDict()
    assert sum(counts[c] for c in SOURCES) == counts["leaves_made"] - counts["left_blank"] and counts["clamped"] > 0 and counts["retried"] > 0
    spark.range(400).write.parquet(str(tmp_path / "ids"))
    ids = spark.readStream.schema("id long").parquet(str(tmp_path / "ids"))
    out = generate_stream(spark, schema, 5, rows=ids, row="id", keep=(), pools=many)
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).drop("row")) == whole


def test_a_large_pool_moves_no_row_twice(spark):
    values = spark.range(700).select(F.concat(F.lit("u"), "id").alias("value"))
    from synthmill.operators.bank import record_use
    from synthmill.plans.banking import empty_bank, now
    bank = record_use(empty_bank(spark), values.select(F.lit("v").alias("category"), F.lit("v").alias("key_name"), "value"), now())
    schema = Schema("s", [Field("v")])
    plan = executed_plan(generate(spark, schema, 1000, 5, pools=pools(bank, schema)))
    assert "Generate" not in plan and "Aggregate" not in plan and "Exchange hash" not in plan


def test_first_values_of_a_run(spark):
    """As many records are made again as the values for the bank take, here more than the first ones."""
    from synthmill.operators.harvest import harvest_run
    from synthmill.plans.run import first_values
    schema = Schema("s", [Field("a", sample="x y", null_rate=97)])
    made = generate_for(spark.range(4000), "id", schema, 3, keep=["id"], bound=4000)
    assert rows(first_values(spark, schema, 4000, 3, 100)) == rows(harvest_run(made, "id", schema, 100)) != []


@pytest.mark.parametrize("name,sf", [("learn_and_generate", "sf0.01"), ("l4_from_bank", "sf0.1"), ("m3_run_job", "sf0.1")])
def test_queries_use_the_whole_bank(spark, name, sf):
    """Where a key has more values than a plan carries."""
    import duckdb

    import __spark_entry__ as contract
    folder, con = f"/root/testdata/{sf}", duckdb.connect()
    for t in ("customer", "events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    got = contract.queries()[name](spark, folder).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cursor.fetchall(), key=str)
