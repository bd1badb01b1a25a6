"""Set-wise naming against the plain row-by-row rules."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window as W, functions as F

from synthmill.functions.naming import NameContext, Naming, clean_segment, compile_name
from synthmill.functions.ranks import grouped_rank, row_index
from synthmill.operators.naming import name_records, resolve_collisions, unique_fragments

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one_by_one(paths, policy, existing):
    disk, used, out = {e.lower() for e in existing}, set(), {}
    for i, p in enumerate(paths):
        def taken(x):
            return x.lower() in used or x.lower() in disk
        if not taken(p) or (policy == "overwrite" and p.lower() not in used):
            name = p
        elif policy == "skip":
            continue
        else:
            folder, _, base = p.rpartition("/")
            dot = base.rfind(".")
            stem, ext = (base[:dot], base[dot:]) if dot > 0 else (base, "")
            n = 2
            while taken(f"{folder + '/' if folder else ''}{stem}_{n}{ext}"):
                n += 1
            name = f"{folder + '/' if folder else ''}{stem}_{n}{ext}"
        used.add(name.lower())
        out[i] = name
    return out


names = st.sampled_from(["a.txt", "A.txt", "a_2.txt", "a_3.txt", "a_2_2.txt", "d/a.txt", "d/a", "d/a_2", ".x", ".x_2", "b"])


@few
@given(st.lists(names, min_size=1, max_size=14), st.lists(names, max_size=4), st.sampled_from(["suffix", "overwrite", "skip"]))
def test_collisions(spark, paths, existing, policy):
    df = spark.createDataFrame(list(enumerate(paths)), "id bigint, path string")
    disk = spark.createDataFrame([(e,) for e in existing], "path string") if existing else None
    got = {r["id"]: r["path"] for r in resolve_collisions(df, "id", "path", policy, disk).collect()}
    assert got == one_by_one(paths, policy, existing)


def fragments_one_by_one(values):
    used, out = set(), []
    for i, f in enumerate(values):
        tries = [f or f"v{i + 1}", f"{f or 'v'}_{i + 1}"] + [f"{f or 'v'}_{i + 1}_{n}" for n in range(2, 50)]
        name = next(t for t in tries if t.lower() not in used)
        used.add(name.lower())
        out.append(name)
    return out


@few
@given(st.lists(st.sampled_from(["", "a", "A", "a_3", "a_4", "a_4_2", "a_2", "v2", "v_3", "b"]), min_size=1, max_size=12))
def test_unique_fragments(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v string")
    out = unique_fragments(df, "id", F.col("v"), "name").orderBy("id").collect()
    assert [r["name"] for r in out] == fragments_one_by_one(values)


def test_a_thousand_clashes_cost_no_more_shuffles(spark):
    """Natural names on all the numbers that one hot name would take, and on those of fragments."""
    paths = [f"a_{2 * i}.txt" if i % 3 else "a.txt" for i in range(1, 3001)]
    df = spark.createDataFrame(list(enumerate(paths)), "id bigint, path string")
    disk = spark.createDataFrame([(f"A_{i}.txt",) for i in range(900, 950)], "path string")
    made = resolve_collisions(df, "id", "path", "suffix", disk)
    assert {r["id"]: r["path"] for r in made.collect()} == one_by_one(paths, "suffix", [f"A_{i}.txt" for i in range(900, 950)])
    values = [f"h_{i + 2}" if i % 2 else ("h" if i % 4 else "h_7") for i in range(2000)]
    out = unique_fragments(spark.createDataFrame(list(enumerate(values)), "id bigint, v string"), "id", F.col("v"), "name").orderBy("id")
    assert [r["name"] for r in out.collect()] == fragments_one_by_one(values)


def test_a_fragment_with_most_rows(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    out = unique_fragments(df, "id", F.col("v"), "name")
    assert out.select(F.lower("name")).distinct().count() == 5000
    assert {r["name"] for r in out.where("id in (0, 3)").collect()} == {"hot", "hot_4"}


def test_ranks_of_hot_groups(spark):
    df = spark.range(3000).select((F.col("id") * 7).alias("id"), F.when(F.col("id") % 3 > 0, None).otherwise(F.col("id") % 5).alias("g"))
    got = grouped_rank(df, ["g"], "id", chunk=64)
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy("id")).cast("long"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert [r["index"] for r in row_index(df, "id", chunk=100).orderBy("id").collect()] == list(range(3000))


@pytest.mark.parametrize("text, mode, want", [
    ("a<b>.. ", "windows", "ab"), ("con", "windows", "_con"), ("LPT1", "windows", "_LPT1"), ("..", "windows", "unnamed"),
    ("né", "ascii", "n_"), ("né", "windows", "né"), ("", "windows", "unnamed")])
def test_clean_segment(text, mode, want):
    assert clean_segment(text, mode) == want


def test_token_forms(spark):
    df = spark.range(2).select("id", F.lit("x/y").alias("f"))
    ctx = NameContext(df.schema, "s", "json", 2, 5)

    def names(pattern, **options):
        options.setdefault("deterministic", True)
        return [r[0] for r in df.select(compile_name(Naming(pattern, **options), ctx, F.col("id"))).collect()]

    assert names("") == ["s_0001.json", "s_0002.json"]
    assert names("{index:99}", index_pad=2)[0] == "000000000001.json"
    assert names("{index:x}{nothing}", index_pad=2)[0] == "01.json"
    assert names("{field:f}/{index}.txt")[1] == "x/y/0002.txt"
    assert names("{field:f|unique}")[1] == "x/y_2.json"
    assert all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-z]{64}\.json", n) for n in names("{uuid8}-{rand:900}"))
    assert names("{uuid}") == names("{uuid}") and len(set(names("{uuid}"))) == 2
    assert names("{ts}") == ["1700000001005.json", "1700000002005.json"]


def test_all_rules_together(spark):
    df = spark.range(6).select("id", F.element_at(F.array(*map(F.lit, ["p", "p", "P", "q", "p_3", "p"])), (F.col("id") + 1).cast("int")).alias("f"))
    ctx = NameContext(df.schema, "s", "csv", 6, 1)
    unique = name_records(df, "id", Naming("{field:f|unique}.{ext}"), ctx).orderBy("id")
    assert [r["path"] for r in unique.collect()] == ["p.csv", "p_2.csv", "P_3.csv", "q.csv", "p_3_5.csv", "p_6.csv"]
    plain = name_records(df, "id", Naming("{field:f}.{ext}", collision="skip", ensure_unique=False), ctx).orderBy("id")
    assert [r["path"] for r in plain.collect()] == ["p.csv", "q.csv", "p_3.csv"]
