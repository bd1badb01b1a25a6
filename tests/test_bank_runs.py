"""The bank of a stream: runs per bucket, against the batch operators."""

import os
import random

from pyspark.sql import functions as F

from synthmill.operators import bank as B
from synthmill.plans.banking import empty_bank, now
from synthmill.streaming.bank_runs import Run, bank_merger, read_bank, start_bank, state, to_merge

ROWS = "category string, key_name string, value string, used_at timestamp_ntz"


def batches(n, seed=3):
    rng = random.Random(seed)
    for b in range(n):
        yield [(rng.choice(["a", "B", "b"]), rng.choice(["k", None, "l"]), rng.choice(["x", " y", "z", "", None, f"v{rng.randrange(9)}"]),
                None) for _ in range(rng.randrange(12))] if b % 4 else []


def entries(bank):
    return sorted(map(str, bank.select(*B.BANK_COLUMNS).collect()))


def stamped(spark, rows, b):
    return spark.createDataFrame(rows, ROWS).withColumn("used_at", F.lit(f"2024-01-01 00:00:{b:02d}").cast("timestamp_ntz"))


def check(spark, folder, ensure):
    """Every state equals that of the batch operator, each batch being run twice; runs stay few."""
    merge = bank_merger(folder, now(), ensure, buckets=2, most=2, retain=1)
    want = empty_bank(spark)
    for b, rows in enumerate(batches(6)):
        frame = stamped(spark, rows, b)
        merge(frame, b)
        merge(frame, b)
        made = (B.record_ensure if ensure else B.record_use)(want, frame, now()).collect()
        want = spark.createDataFrame(made, empty_bank(spark).schema)
        if b in (2, 5):
            assert entries(read_bank(spark, folder)) == entries(want)
    for bucket in (0, 1):
        assert sum(os.path.isdir(f"{folder}/{run}/bucket={bucket}") for run in os.listdir(folder)) <= 8


def test_uses_of_batches_are_those_of_one_bank(spark, tmp_path):
    check(spark, str(tmp_path / "bank"), False)


def test_ensured_values_of_batches_are_those_of_one_bank(spark, tmp_path):
    check(spark, str(tmp_path / "bank"), True)


def test_a_folder_begins_with_a_bank_and_keeps_corrected_ids(spark, tmp_path):
    folder = str(tmp_path / "bank")
    assert read_bank(spark, folder) is None
    bank = B.record_use(empty_bank(spark), stamped(spark, [("a", "k", "x", None), ("a", "k", "y", None)], 1), now())
    known = {r["value"]: r["id"] for r in bank.collect()}
    edits = spark.createDataFrame([(known["x"], "w")], "id string, value string")
    start_bank(B.correct(bank, edits, now()), folder, buckets=2)
    merge = bank_merger(folder, now(), buckets=2, most=2)
    for b in range(4):
        merge(stamped(spark, [("a", "k", "w", None), ("a", "k", "y", None)], b), b)
    got = {r["value"]: (r["id"], r["use_count"]) for r in read_bank(spark, folder).collect()}
    assert got == {"w": (known["x"], 5), "y": (known["y"], 5)}
    assert read_bank(spark, folder, before=-1) is None


def test_a_batch_writes_and_merges_only_what_it_touches(spark, tmp_path):
    folder = str(tmp_path / "bank")
    merge = bank_merger(folder, now(), buckets=8, most=2)
    merge(stamped(spark, [("a", "k", f"v{i}", None) for i in range(200)], 0), 0)
    before = {d: os.stat(f"{folder}/run=0.0/{d}").st_mtime_ns for d in os.listdir(f"{folder}/run=0.0")}
    for b in range(1, 6):
        merge(stamped(spark, [("a", "k", "v1", None)], b), b)
    assert len([d for d in before if d.startswith("bucket=")]) == 8
    touched = {d for run in os.listdir(folder) if run != "run=0.0" for d in os.listdir(f"{folder}/{run}") if d.startswith("bucket=")}
    assert len(touched) == 1
    assert all(os.stat(f"{folder}/run=0.0/{d}").st_mtime_ns == t for d, t in before.items() if d not in touched)
    got = {r["value"]: r["use_count"] for r in read_bank(spark, folder).collect()}
    assert got == {f"v{i}": 6 if i == 1 else 1 for i in range(200)}


def test_an_unfinished_run_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "bank")
    merge = bank_merger(folder, now())
    merge(stamped(spark, [("a", "k", "x", None)], 0), 0)
    merge(stamped(spark, [("a", "k", "x", None)], 1), 1)
    os.remove(f"{folder}/run=1.1/_SUCCESS")
    assert [r["use_count"] for r in read_bank(spark, folder).collect()] == [1]


def test_widest_runs_make_a_state():
    runs = [Run(0, 0, 1, 9), Run(1, 1, 1, 9), Run(0, 1, 1, 9), Run(2, 2, 1, 9), Run(4, 4, 2, 9)]
    assert state(runs) == {1: [runs[3], runs[2]], 2: [runs[4]]}
    assert state(runs, 1) == {1: [runs[0]]}
    assert state(runs, 0) == {}


def test_an_older_run_is_merged_when_the_newer_ones_have_its_size():
    own = [Run(b, b, 0, size) for b, size in ((9, 1), (8, 1), (7, 5), (6, 80))]
    assert to_merge(own, 4) == []
    assert to_merge(own, 3) == own[:2]
    assert to_merge([Run(9, 9, 0, 4), *own[1:]], 3) == [Run(9, 9, 0, 4), *own[1:3]]


def test_rewritten_bytes_grow_with_the_logarithm():
    """A thousand batches of one size: each byte is written a few times, not a thousand."""
    runs, written = [], 0
    for b in range(1000):
        runs = [Run(b, b, 0, 1), *runs]
        if chosen := to_merge(runs, 8):
            size = sum(r.size for r in chosen)
            written += size
            runs = [Run(chosen[-1].first, b, 0, size), *runs[len(chosen):]]
        assert len(runs) <= 8
    assert sum(r.size for r in runs) == 1000 and written < 10 * 1000
