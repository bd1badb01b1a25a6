"""Headline timings; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from synthmill.operators.generate import generate
from synthmill.plans.catalog import QUERIES
from synthmill.plans.generation import CUSTOMER, NESTED, SEED

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# One per family: generation, bank, inference, reshape, names, reports, sinks, packages, streams.
NAMES = ["g1_generate", "g4_array", "l4_from_bank", "l23_unique_wide", "l27_regex_retry", "m1_report",
         "h3_record_use", "h10_values_for_key", "h11_values_for_keys", "h20_correct_merge",
         "i3_harvest_documents", "i3_harvest_values", "i7_detect_kind", "i13_infer_corpus",
         "x2_flatten_arrays", "x6_entity_split", "x10_split_n", "n5_field_unique", "n8_collision_suffix",
         "k3_write_csv", "k10_write_archive", "p4_variants", "t2_bank_stream", "learn_and_generate"]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work: Callable[[], None]) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("synthmill-bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.range(1000))
    times = {}
    for name in NAMES:
        run(QUERIES[name](spark, "/root/testdata/sf0.001")) if os.path.isdir("/root/testdata/sf0.001") else None
        times[name] = timed(lambda: run(QUERIES[name](spark, SF_DIR)))
    for name, schema in (("generate_1m_flat", CUSTOMER), ("generate_1m_nested", NESTED)):
        times[name] = timed(lambda: run(generate(spark, schema, 1_000_000, SEED)))
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
