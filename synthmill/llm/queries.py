"""The queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from synthmill.functions.scratch import shared_folder
from synthmill.llm.bpe import encode_decode
from synthmill.llm.common import documents
from synthmill.llm.conversations import conversations, damaged, keyed, rows_reported
from synthmill.llm.counts import edited_counts
from synthmill.llm.fingerprints import compared
from synthmill.llm.jaccard import linked
from synthmill.llm.packing import pack
from synthmill.llm.periodic import periodic
from synthmill.llm.quality import quality
from synthmill.llm.repeats import dedup
from synthmill.llm.secrets import scan
from synthmill.llm.sharding import placed
from synthmill.llm.simhash import near
from synthmill.llm.warc import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits to every document: a deletion, an insertion, a replacement by the text's own beginning."""
    n = "char_length(text)"
    edits = F.expr(f"""array(
        named_struct('seq', 1, 'start', {n} div 4, 'length', 40, 'insert', ''),
        named_struct('seq', 2, 'start', {n} div 2, 'length', 0, 'insert', ' (as amended)\\n'),
        named_struct('seq', 3, 'start', {n} * 3 div 4, 'length', 20, 'insert', substr(text, 1, 60)))""")
    return edited_counts(documents(spark, sf_dir).withColumn("edits", edits),
                         public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(documents(spark, sf_dir).select("doc_id"), "doc_id", [f"shard-{i:03d}" for i in range(128)])


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_folder(spark))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def with_repetitions(docs: DataFrame) -> DataFrame:
    """``documents`` of which a tenth, by the checksum of the key, repeat words from some place on, with a period of their own."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    df = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    df = df.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, cast(g % n AS int), 0)"))
    df = df.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    repeated = F.expr("array_join(transform(sequence(0, n - 1), i -> words[if(i < a, i, a + (i - a) % p)]), ' ')")
    return df.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic(with_repetitions(documents(spark, sf_dir)))
    longest = F.expr("element_at(array_sort(runs, (x, y) -> CASE WHEN x.length <> y.length THEN if(x.length > y.length, -1, 1) "
                     "WHEN x.start <> y.start THEN if(x.start < y.start, -1, 1) WHEN x.period < y.period THEN -1 WHEN x.period > y.period THEN 1 ELSE 0 END), 1)")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("longest", F.when(F.size("runs") > 0, longest)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return rows_reported(keyed(damaged(rows)))


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(documents(spark, sf_dir))
