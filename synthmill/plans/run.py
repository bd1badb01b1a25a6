"""A whole run as one job: records, report, manifest beside them, and what the bank learns from them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from synthmill.functions.scratch import scratch
from synthmill.operators import bank as B
from synthmill.operators.generate import generate_for, observed_counts
from synthmill.operators.harvest import harvest_run
from synthmill.operators.leaves import ARRAY_SLOTS
from synthmill.operators.pools import Pools, pools
from synthmill.operators.report import build_manifest, write_manifest
from synthmill.plans.banking import bank_from_events
from synthmill.plans.duck import Leaf
from synthmill.plans.registry import query, table
from synthmill.schema import Field, Schema
from synthmill.sinks.files import write_csv

ROW = "__row"


@dataclass(frozen=True)
class Run:
    """What a run leaves behind: folder of the records, file of the manifest, one-row report, bank after it."""

    records: str
    manifest: str
    report: DataFrame
    bank: DataFrame | None


def first_values(spark: SparkSession, schema: Schema, n: int, seed: int, cap: int, **given) -> DataFrame:
    """The first ``cap`` values that a run of ``n`` records gives the bank, from no more records than it takes."""
    records = min(n, cap)
    while True:
        made = generate_for(spark.range(records).withColumnRenamed("id", ROW), ROW, schema, seed, keep=[ROW], bound=n, **given)
        found = harvest_run(made, ROW, schema, cap)
        if records == n or found.count() >= cap:
            return found
        records = min(n, records * 16)


def run_job(spark: SparkSession, schema: Schema, n: int, seed: int, output: str, *, created_at: str, fmt: str = "csv",
            write: Callable[[DataFrame, str], None] = partial(write_csv, slots=ARRAY_SLOTS), bank: DataFrame | None = None,
            values: Mapping[str, Sequence[str]] | None = None, from_pools: Pools | None = None, record_history: bool = True) -> Run:
    """Generate ``n`` records to ``output``, write the manifest with their counters beside, and add their values to ``bank``.

    The counters are observed while the records are written, in the same pass; ``write`` must write the frame as it is given.
    ``values`` or ``from_pools`` are bank values to draw from; without them the run depends on schema and seed only.  The bank
    takes up to ``run_cap(n)`` values in row order, and none if it is not given or ``record_history`` is off.
    """
    n = max(int(n), 1)
    observed = Observation()
    rows = spark.range(n).withColumnRenamed("id", ROW)
    given = {"bank": values, "pools": from_pools}
    write(generate_for(rows, ROW, schema, seed, bound=n, observed=observed, **given), output)
    report = observed_counts(spark, observed)
    manifest = build_manifest(report, schema, seed=seed, record_count=n, ci_mode=not values and from_pools is None, fmt=fmt,
                              created_at=created_at, record_history=record_history and bank is not None)
    target = write_manifest(manifest, output)
    if bank is not None and record_history:
        now = F.lit(created_at.replace("T", " ").removesuffix("Z")).cast("timestamp_ntz")
        bank = B.record_use(bank, first_values(spark, schema, n, seed, B.run_cap(n), **given), now)
    return Run(output, target, report, bank)


_LEAVES, _SEED = 4, 42
_DRAWN = Leaf(_SEED, "v", "c_custkey").chance("source", .5)


@query("m3_run_job", f"""SELECT unnest(['record_count', 'records', 'leaves_made', 'bank_values', 'learned']) AS figure,
  unnest([count(*), count(*), count(*) * {_LEAVES}, sum(({_DRAWN})::INT), least(count(*) * {_LEAVES}, least(greatest(20 * count(*), 200), 5000))])::BIGINT AS value
  FROM customer""")
def m3_run_job(spark, sf_dir):
    """As many records as there are customers, with values from the bank of the events; read back are the records, the counters and the bank's uses."""
    schema = Schema("run", [Field("code", sample="1000000000", is_unique=True), Field("city", sample="Seattle"), Field("share", sample="45.5%"),
                            Field("v", source_keys=["click"])])
    bank = bank_from_events(table(spark, sf_dir, "events"))
    done = run_job(spark, schema, table(spark, sf_dir, "customer").count(), _SEED, f"{scratch(spark, 'run')}/records.csv",
                   created_at="2024-06-15T00:00:00Z", bank=bank, from_pools=pools(bank, schema))
    doc = spark.read.text(done.manifest, wholetext=True)

    def counted(*names: str) -> DataFrame:
        return doc.select(reduce(lambda a, b: a + b, [F.get_json_object("value", f"$.{n}").cast("long") for n in names]))
    before, after = (b.agg(F.sum("use_count").alias("uses")) for b in (bank, done.bank))
    figures = {"record_count": counted("recordCount"), "leaves_made": counted("report.leaves_made"),
               "bank_values": counted("report.from_bank_literal", "report.from_bank_joined"),
               "records": spark.read.csv(done.records, header=True).agg(F.count("*")),
               "learned": after.join(before.withColumnRenamed("uses", "earlier")).select(F.col("uses") - F.col("earlier"))}
    return reduce(DataFrame.unionByName, [df.toDF("value").select(F.lit(name).alias("figure"), "value") for name, df in figures.items()])
