"""Queries over a value bank that is built from the whole events table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from synthmill.functions.lineage import kept
from synthmill.operators import bank as B
from synthmill.plans.registry import query, table

NOW = datetime(2024, 2, 1)
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def now() -> Column:
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def stamp(c: str) -> Column:
    return F.date_format(F.col(c), STAMP).alias(c)


def event_rows(events: DataFrame) -> DataFrame:
    """Uses of values: who did what, and with which properties."""
    user = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    return events.select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("used_at"),
        F.explode(F.array(
            F.struct(F.col("event_type").alias("category"), F.col("event_type").alias("key_name"), user.alias("value")),
            F.struct(F.lit("Props").alias("category"), F.concat(F.col("event_type"), F.lit(".props")).alias("key_name"),
                     F.col("props").alias("value")))).alias("r")).select("event_id", "used_at", "r.*")


def empty_bank(spark) -> DataFrame:
    return spark.createDataFrame([], "id string, category_id string, key_name string, value string,"
                                     " use_count bigint, last_used_at timestamp_ntz, created_at timestamp_ntz")


def bank_from_events(events: DataFrame) -> DataFrame:
    return B.record_use(empty_bank(events.sparkSession), event_rows(events), now())


def categories_from_events(events: DataFrame) -> DataFrame:
    none = events.sparkSession.createDataFrame([], "id string, name string, source_key string, created_at timestamp_ntz")
    return B.ensure_categories(none, event_rows(events).withColumn("pos", F.col("event_id")), now())


def both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    return bank_from_events(events), categories_from_events(events)


_ROWS = """rows AS (
  SELECT event_id, ts AS used_at, event_type AS category, event_type AS key_name, 'u' || lpad(user_id::VARCHAR, 6, '0') AS value FROM events
  UNION ALL SELECT event_id, ts, 'Props', event_type || '.props', props FROM events)"""
_BANK = _ROWS + """,
bank AS (SELECT md5(md5(lower(category)) || chr(31) || key_name || chr(31) || value) AS id, md5(lower(category)) AS category_id,
    any_value(category) AS category_name, key_name, value, count(*) AS use_count, max(used_at) AS last_used_at, min(used_at) AS created_at
  FROM rows GROUP BY category, key_name, value)"""
_T = "%Y-%m-%d %H:%M:%S.%f"
_COLS = f"id, key_name, value, use_count, strftime(last_used_at, '{_T}') AS last_used_at"
_SHOW = ["id", "key_name", "value", "use_count"]


def show(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*_SHOW, stamp("last_used_at"), *extra)


@query("h3_record_use", f"""WITH {_BANK},
 more AS (SELECT md5(lower(event_type)) AS category_id, event_type AS key_name, 'u' || lpad((user_id % 200)::VARCHAR, 6, '0') AS value, count(*) AS n
          FROM events WHERE value > 10 GROUP BY ALL),
 merged AS (SELECT coalesce(b.category_id, m.category_id) AS category_id, coalesce(b.key_name, m.key_name) AS key_name, coalesce(b.value, m.value) AS value,
   coalesce(use_count, 0) + coalesce(n, 0) AS use_count,
   CASE WHEN n IS NULL THEN last_used_at ELSE TIMESTAMP '2024-02-01' END AS last_used_at
   FROM bank b FULL JOIN more m ON b.category_id = m.category_id AND b.key_name = m.key_name AND b.value = m.value)
SELECT md5(category_id || chr(31) || key_name || chr(31) || value) AS id, key_name, value, use_count, strftime(last_used_at, '{_T}') AS last_used_at FROM merged""")
def h3(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    more = events.where("value > 10").select(
        F.upper("event_type").alias("category"), F.col("event_type").alias("key_name"),
        F.concat(F.lit("  u"), F.lpad((F.col("user_id") % 200).cast("string"), 6, "0"), F.lit("\t")).alias("value"))
    return show(B.record_use(bank_from_events(events), more, now()))


@query("h4_record_ensure", f"""WITH {_BANK},
 more AS (SELECT DISTINCT md5(lower(event_type)) AS category_id, event_type AS key_name, 'u' || lpad((user_id + 100)::VARCHAR, 6, '0') AS value FROM events)
SELECT {_COLS} FROM bank UNION ALL
SELECT md5(category_id || chr(31) || key_name || chr(31) || value), key_name, value, 1, '2024-02-01 00:00:00.000000' FROM more m
WHERE NOT EXISTS (SELECT 1 FROM bank b WHERE b.category_id = m.category_id AND b.key_name = m.key_name AND b.value = m.value)""")
def h4(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    more = events.select(F.col("event_type").alias("category"), F.col("event_type").alias("key_name"),
                         F.concat(F.lit("u"), F.lpad((F.col("user_id") + 100).cast("string"), 6, "0")).alias("value"))
    return show(B.record_ensure(bank_from_events(events), more, now()))


@query("h5_ensure_categories", """
WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '  ' WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type || ' ' END AS c, event_type AS k FROM events),
 n AS (SELECT *, CASE WHEN trim(c) = '' THEN 'uncategorized' ELSE trim(c) END AS name FROM r)
SELECT md5(lower(name)) AS id, arg_min(name, event_id) AS name, arg_min(k, event_id) AS source_key FROM n GROUP BY lower(name)""")
def h5(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 7 == 0, "  ").when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(
        F.concat("event_type", F.lit(" ")))
    rows = events.select(name.alias("category"), F.col("event_type").alias("key_name"), F.col("event_id").alias("pos"))
    none = spark.createDataFrame([], "id string, name string, source_key string, created_at timestamp_ntz")
    return B.ensure_categories(none, rows, now()).select("id", "name", "source_key")


@query("h6_suggest", f"""WITH {_BANK} SELECT {_COLS} FROM bank
WHERE category_id = md5('click') AND lower(key_name) = 'click' AND starts_with(lower(value), 'u0000') ORDER BY use_count DESC, bank.last_used_at DESC, id LIMIT 40""")
def h6(spark, sf_dir):
    return show(B.suggest(both(spark, sf_dir)[0], category="Click", key="CLICK", prefix="U0000", limit=40))


@query("h7_recent", f"WITH {_BANK} SELECT {_COLS}, category_name FROM bank ORDER BY bank.last_used_at DESC, id DESC LIMIT 150")
def h7(spark, sf_dir):
    return show(B.recent(*both(spark, sf_dir), 150), "category_name")


@query("h8_page", f"WITH {_BANK} SELECT {_COLS}, category_name FROM bank WHERE contains(lower(key_name), 'props') ORDER BY bank.last_used_at DESC, id DESC LIMIT 100 OFFSET 50")
def h8(spark, sf_dir):
    return show(B.page(*both(spark, sf_dir), 50, 100, " PROPS ")[0], "category_name")


@query("h8_page_total", f"WITH {_BANK} SELECT count(*) AS total FROM bank WHERE contains(lower(key_name), 'props')")
def h8_total(spark, sf_dir):
    return B.page(*both(spark, sf_dir), 50, 100, "props")[1]


@query("h9_search", f"""WITH {_BANK} SELECT {_COLS} FROM bank
WHERE contains(lower(key_name), '": 4') OR contains(lower(value), '": 4') OR contains(lower(category_name), '": 4')""")
def h9(spark, sf_dir):
    return show(B.search(*both(spark, sf_dir), '": 4'))


_RANKED = """ranked AS (SELECT lower(key_name) AS key, value, row_number() OVER (PARTITION BY lower(key_name) ORDER BY use_count DESC, last_used_at DESC, value) AS rank
 FROM bank WHERE lower(category_name) = lower(key_name))"""


@query("h10_values_for_key", f"WITH {_BANK}, {_RANKED} SELECT key, rank, value FROM ranked WHERE rank <= 500")
def h10(spark, sf_dir):
    return B.values_for_key(both(spark, sf_dir)[0]).withColumn("rank", F.col("rank").cast("long"))


@query("h11_values_for_keys", f"""WITH {_BANK}, {_RANKED},
 placed AS (SELECT value, CASE key WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS key_pos, rank FROM ranked WHERE rank <= 500 AND key IN ('view', 'click', 'error'))
SELECT value, first.p AS key_pos, first.r AS rank FROM (SELECT value, min({{'p': key_pos, 'r': rank}}) AS first FROM placed GROUP BY value)
ORDER BY first LIMIT 500""")
def h11(spark, sf_dir):
    out = B.values_for_keys(both(spark, sf_dir)[0], ["View", "click", "VIEW", "error"])
    return out.select("value", F.col("key_pos").cast("int").alias("key_pos"), F.col("rank").cast("long").alias("rank"))


@query("h12_keys", f"""WITH {_BANK}, n AS (SELECT DISTINCT key_name FROM bank),
 b AS (SELECT 0 AS pos, key_name AS name FROM n UNION ALL SELECT 1, split_part(key_name, '.', -1) FROM n)
SELECT name FROM (SELECT name, min(pos) AS pos FROM b WHERE starts_with(lower(name), 'p') GROUP BY name) ORDER BY pos, name LIMIT 30""")
def h12(spark, sf_dir):
    return B.keys(both(spark, sf_dir)[0], "P")


@query("h13_top_keys", f"WITH {_BANK} SELECT key_name, sum(use_count)::BIGINT AS uses FROM bank GROUP BY key_name ORDER BY uses DESC, key_name LIMIT 8")
def h13(spark, sf_dir):
    return B.top_keys(both(spark, sf_dir)[0], 8)


@query("h14_clear_days_newer", f"WITH {_BANK} SELECT {_COLS} FROM bank WHERE bank.last_used_at < TIMESTAMP '2024-01-29'")
def h14_newer(spark, sf_dir):
    return show(B.clear(both(spark, sf_dir)[0], "days", days=3, now=NOW))


@query("h14_clear_days_older", f"WITH {_BANK} SELECT {_COLS} FROM bank WHERE bank.last_used_at >= TIMESTAMP '2024-01-29'")
def h14_older(spark, sf_dir):
    return show(B.clear(both(spark, sf_dir)[0], "days", days=3, now=NOW, age="older"))


@query("h15_clear_datetime", f"WITH {_BANK} SELECT {_COLS} FROM bank WHERE bank.last_used_at >= TIMESTAMP '2024-01-30 06:00:00'")
def h15(spark, sf_dir):
    return show(B.clear(both(spark, sf_dir)[0], "datetime", cutoff=datetime(2024, 1, 30, 6)))


@query("h16_count_clear", f"WITH {_BANK} SELECT count(*) AS rows FROM bank WHERE last_used_at < TIMESTAMP '2024-01-30 06:00:00'")
def h16(spark, sf_dir):
    return B.count_clear(both(spark, sf_dir)[0], "datetime", cutoff=datetime(2024, 1, 30, 6))


@query("h17_delete_ids", f"""WITH {_BANK}, gone AS (SELECT id FROM bank WHERE use_count >= 5)
SELECT {_COLS} FROM bank WHERE id NOT IN (SELECT id FROM gone)""")
def h17(spark, sf_dir):
    bank = both(spark, sf_dir)[0]
    gone = bank.where("use_count >= 5").select(F.concat(F.lit(" "), "id").alias("id"))
    return show(B.delete_ids(bank, gone))


@query("h18_delete_matching", f"WITH {_BANK} SELECT {_COLS} FROM bank WHERE NOT (contains(lower(key_name), 'sign') OR contains(lower(value), 'sign') OR contains(lower(category_name), 'sign'))")
def h18(spark, sf_dir):
    return show(B.delete_matching(*both(spark, sf_dir), "SIGN"))


@query("h19_correct", f"""WITH {_BANK}
SELECT id, key_name, CASE WHEN use_count = 1 THEN value || '!' ELSE value END AS value, use_count,
  CASE WHEN use_count = 1 THEN '2024-02-01 00:00:00.000000' ELSE strftime(last_used_at, '{_T}') END AS last_used_at FROM bank""")
def h19(spark, sf_dir):
    bank = kept(both(spark, sf_dir)[0], "bank")
    edits = bank.where("use_count = 1").select("id", F.concat("value", F.lit("! ")).alias("value"))
    return show(B.correct(bank, edits, now()))


@query("h20_correct_merge", f"""WITH {_BANK},
 e AS (SELECT *, CASE WHEN starts_with(value, 'u') AND value[-1] = '7' THEN value[:-2] || '0' ELSE value END AS v2 FROM bank),
 m AS (SELECT category_id, key_name, v2 AS value, sum(use_count)::BIGINT AS use_count, arg_min(id, {{'e': (v2 <> value)::INT, 'id': id}}) AS id,
   coalesce(max(CASE WHEN v2 <> value THEN TIMESTAMP '2024-02-01' END), max(last_used_at)) AS last_used_at FROM e GROUP BY ALL)
SELECT {_COLS} FROM m""")
def h20(spark, sf_dir):
    bank = kept(both(spark, sf_dir)[0], "bank")
    edits = bank.where("startswith(value, 'u') AND endswith(value, '7')").select(
        "id", F.concat(F.expr("left(value, length(value) - 1)"), F.lit("0")).alias("value"))
    return show(B.correct(bank, edits, now()))


@query("h21_prune_categories", f"""WITH {_BANK} SELECT DISTINCT category_id AS id FROM bank
WHERE NOT (contains(lower(key_name), 'click') OR contains(lower(value), 'click') OR contains(lower(category_name), 'click'))""")
def h21(spark, sf_dir):
    bank, categories = both(spark, sf_dir)
    kept = B.delete_matching(bank, categories, "click")
    return B.prune_categories(categories, kept).select("id")


@query("h22_snapshot", f"WITH {_BANK} SELECT {_COLS}, category_name FROM bank ")
def h22(spark, sf_dir):
    return show(B.snapshot(*both(spark, sf_dir)), "category_name")


@query("h23_restore", f"""WITH {_BANK}, more AS (
 SELECT DISTINCT md5('restored') AS category_id, 'restored' AS key_name, 'u' || user_id AS value FROM events UNION
 SELECT DISTINCT md5('click'), 'click', 'u' || lpad((user_id + 50)::VARCHAR, 6, '0') FROM events)
SELECT key_name, value, use_count FROM bank UNION ALL
SELECT key_name, value, 1 FROM more m WHERE NOT EXISTS (SELECT 1 FROM bank b WHERE b.category_id = m.category_id AND b.key_name = m.key_name AND b.value = m.value)""")
def h23(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(F.explode(F.array(
        F.struct(F.lit("").alias("category_name"), F.lit("restored").alias("key_name"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("value")),
        F.struct(F.lit("click").alias("category_name"), F.lit(None).cast("string").alias("key_name"),
                 F.concat(F.lit("u"), F.lpad((F.col("user_id") + 50).cast("string"), 6, "0")).alias("value")),
        F.struct(F.lit(" ").alias("category_name"), F.lit(None).cast("string").alias("key_name"), F.lit("lost").alias("value")))).alias("r")).select("r.*")
    return B.restore(bank_from_events(events), rows, now()).select("key_name", "value", "use_count")


@query("h24_counts", f"WITH {_BANK} SELECT 'bank' AS store, count(*) AS rows FROM bank UNION ALL SELECT 'categories', count(DISTINCT category_id) FROM bank")
def h24(spark, sf_dir):
    bank, categories = both(spark, sf_dir)
    return B.counts(bank=bank, categories=categories)
