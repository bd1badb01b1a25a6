"""Run reports and manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from synthmill.operators.leaves import BANK_JOINED, BANK_LITERAL, BLANK, MADE
from synthmill.schema import Schema

APP = "synthmill"
VERSION = "1.0.0"


def _percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, half up; 0 of nothing is 0."""
    return F.when(whole > 0, F.floor(part * F.lit(1000.0) / whole + F.lit(0.5)) / F.lit(10.0)).otherwise(F.lit(0.0))


def report_rates(counts: DataFrame) -> DataFrame:
    """Add the share of bank values among filled leaves and that of blank ones among all."""
    filled = F.col(MADE) - F.col(BLANK)
    return counts.withColumns({"bank_percent": _percent(F.col(BANK_LITERAL) + F.col(BANK_JOINED), filled),
                               "blank_percent": _percent(F.col(BLANK), F.col(MADE))})


def build_manifest(report: DataFrame, schema: Schema, *, seed: int, record_count: int, ci_mode: bool,
                   fmt: str | None, created_at: str, record_history: bool = False) -> DataFrame:
    """One-row frame ``manifest`` with the JSON that describes and replays a run."""
    fixed = {"app": APP, "version": VERSION, "createdAt": created_at, "seed": seed, "ciMode": ci_mode,
             "recordCount": record_count, "format": fmt, "schemaId": schema.id, "schemaName": schema.name,
             "schemaHash": schema.hash(), "recordHistory": record_history}
    columns = [F.lit(v).alias(k) for k, v in fixed.items() if v is not None]
    return report.select(F.to_json(F.struct(*columns, F.struct(*report.columns).alias("report"))).alias("manifest"))


def manifest_path(output: str) -> str:
    """Manifest beside an output: ``dir/foo.json`` gives ``dir/foo.manifest.json``."""
    folder, _, base = output.replace("\\", "/").rpartition("/")
    stem = base.rsplit(".", 1)[0] if "." in base else base
    return f"{folder}/{stem}.manifest.json" if folder else f"{stem}.manifest.json"


def write_manifest(manifest: DataFrame, output: str) -> str:
    """Write the one-row manifest beside the output, as one file of its file system; returns its path."""
    target, spark = manifest_path(output), manifest.sparkSession
    text = manifest.first()["manifest"]
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return target


def replay_arguments(text: str) -> dict:
    """Arguments that generate the run of a manifest again."""
    doc = json.loads(text)
    return {"n": int(doc["recordCount"]), "seed": int(doc["seed"]) & 0xFFFFFFFF}


def parse_manifests(files: DataFrame, text: str = "content") -> DataFrame:
    """Typed manifest columns of many JSON texts, with ``problem`` set where one cannot be used."""
    v = F.try_parse_json(text)

    def get(name: str, dtype: str) -> Column:
        return F.try_variant_get(F.col("__v"), f"$.{name}", dtype)

    parsed = files.withColumn("__v", v).select(
        *files.columns, F.schema_of_variant("__v").alias("__shape"),
        F.coalesce(F.schema_of_variant(F.try_variant_get("__v", "$.seed", "variant")), F.lit("VOID")).alias("__seed"),
        F.coalesce(F.schema_of_variant(F.try_variant_get("__v", "$.schemaHash", "variant")), F.lit("VOID")).alias("__hash"),
        F.coalesce(F.schema_of_variant(F.try_variant_get("__v", "$.recordCount", "variant")), F.lit("VOID")).alias("__count"),
        get("seed", "double").alias("__seed_value"), get("recordCount", "double").alias("__n"),
        get("schemaHash", "string").alias("schema_hash"), get("schemaId", "string").alias("schema_id"),
        get("schemaName", "string").alias("schema_name"), get("format", "string").alias("format"),
        F.coalesce(get("version", "string"), F.lit("unknown")).alias("version"),
        F.coalesce(get("ciMode", "boolean"), F.lit(False)).alias("ci_mode"),
        F.coalesce(get("recordHistory", "boolean"), F.lit(False)).alias("record_history"))
    number = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
    problem = (F.when(F.col("__shape").isNull() | ~F.startswith("__shape", F.lit("OBJECT<")), "not a JSON object")
               .when(~F.col("__seed").rlike(number), "no numeric seed")
               .when(~F.col("__count").rlike(number) | (F.col("__n") < 1), "no valid record count")
               .when((F.col("__hash") != "STRING") | (F.col("schema_hash") == ""), "no schema hash"))
    seed = F.pmod(F.floor("__seed_value"), F.lit(2 ** 32).cast("long"))
    return parsed.select(
        *files.columns, problem.alias("problem"), F.when(problem.isNull(), seed).alias("seed"),
        F.when(problem.isNull(), F.floor("__n")).alias("record_count"), "schema_hash", "schema_id", "schema_name",
        "format", "version", "ci_mode", "record_history")


def compare_manifests(manifests: DataFrame, schemas: DataFrame) -> DataFrame:
    """Match flags and warnings of each manifest against the open schemas.

    ``schemas`` has (schema_key, id, name, hash); a manifest names the one it is compared with in
    ``schema_key``.  The id and name flags are NULL where the manifest does not carry them.
    """
    current = schemas.select("schema_key", F.col("id").alias("__id"), F.col("name").alias("__name"), F.col("hash").alias("current_hash"))
    out = manifests.join(current, "schema_key", "left")
    open_ = F.col("current_hash").isNotNull()

    def same(mine: str, theirs: str) -> Column:
        return F.when(open_ & (F.coalesce(F.col(mine), F.lit("")) != ""), F.col(mine) == F.col(theirs))

    hash_match = F.coalesce(F.col("schema_hash") == F.col("current_hash"), F.lit(False))
    id_match, name_match = same("schema_id", "__id"), same("schema_name", "__name")
    warnings = F.array_compact(F.array(
        F.when(~open_, "no schema to compare with"),
        F.when(open_ & ~hash_match, "schema structure differs"),
        F.when(~id_match, "schema id differs"), F.when(~name_match, "schema name differs"),
        F.when(open_ & ~F.col("ci_mode"), "run used live bank values")))
    return out.select(*manifests.columns, F.coalesce("current_hash", F.lit("none")).alias("current_hash"),
                      hash_match.alias("hash_match"), id_match.alias("id_match"), name_match.alias("name_match"),
                      warnings.alias("warnings"))
