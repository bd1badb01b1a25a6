"""The value bank: observed values per key, kept as immutable frames.

A bank frame has the columns ``BANK_COLUMNS`` and is unique on (category_id, key_name, value).
Every change returns a new frame; the caller writes it as the next snapshot.  Ids are hashes of
what they identify, so a recomputed task gives the same ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from synthmill.functions.kinds import trim
from synthmill.schema import Schema

BANK_COLUMNS = ("id", "category_id", "key_name", "value", "use_count", "last_used_at", "created_at")
IDENTITY = ["category_id", "key_name", "value"]
UNCATEGORIZED = "uncategorized"

# Fixed value: the longest age of a clear request.
MAX_CLEAR_DAYS = 36_500
#: Values of a key that a generation plan carries unless the caller says otherwise: they are literals of the plan.
VALUES_PER_KEY = 500


def at_least_one(limit: int) -> int:
    return max(1, int(limit))


def category_name(name: Column) -> Column:
    cleaned = trim(name)
    return F.when(cleaned.isNull() | (cleaned == ""), UNCATEGORIZED).otherwise(cleaned)


def category_id(name: Column) -> Column:
    """Id of a category; names that differ only in case share it."""
    return F.md5(F.lower(category_name(name)))


def entry_id(category: Column, key: Column, value: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", category, key, value))


def _clean(rows: DataFrame) -> DataFrame:
    """(category, key_name, value, …) rows with trimmed values; blank values are dropped."""
    value = trim(F.col("value"))
    return (rows.withColumns({"value": value, "category_id": category_id(F.col("category"))})
            .where(F.col("value").isNotNull() & (F.col("value") != "")))


# -- writing ------------------------------------------------------------------------------
def uses(rows: DataFrame, now: Column) -> DataFrame:
    """The entries that rows make by themselves: one use per row, at ``used_at`` where they carry it, else ``now``.

    Repeats are combined before the shuffle, so a value that makes up much of the input moves once per task.
    """
    used_at = F.col("used_at") if "used_at" in rows.columns else now
    found = (_clean(rows).withColumn("used_at", used_at).groupBy(*IDENTITY)
             .agg(F.count("*").alias("use_count"), F.max("used_at").alias("last_used_at"),
                  F.min("used_at").alias("created_at")))
    return found.withColumn("id", entry_id(*[F.col(c) for c in IDENTITY])).select(*BANK_COLUMNS)


def merge_uses(entries: DataFrame, corrected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entries of equal identity as one; ``corrected`` has the ids (``kept``) that do not follow from an identity."""
    # Numbers and times only, so that Spark can hash; ids follow from what they identify, but for corrected entries.
    merged = (entries.groupBy(*by, *IDENTITY)
              .agg(F.sum("use_count").alias("use_count"), F.max("last_used_at").alias("last_used_at"),
                   F.min("created_at").alias("created_at")))
    same = [merged[c].eqNullSafe(F.col(f"__{c}")) for c in (*by, *IDENTITY)]
    renamed = corrected.select(*[F.col(c).alias(f"__{c}") for c in (*by, *IDENTITY)], "kept")
    own = entry_id(*[F.col(c) for c in IDENTITY])
    return merged.join(renamed, same, "left").withColumn("id", F.coalesce("kept", own)).select(*BANK_COLUMNS, *by)


def record_use(bank: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Insert new values and add one use per row for known ones.

    Rows may carry ``used_at``; otherwise ``now`` is the time of use.
    """
    own = entry_id(*[F.col(c) for c in IDENTITY])
    corrected = bank.where(F.col("id") != own).select(*IDENTITY, F.col("id").alias("kept"))
    return merge_uses(bank.select(*BANK_COLUMNS).unionByName(uses(rows, now)), corrected)


def missing_values(bank: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """An entry for each value of the rows that the bank does not have."""
    found = _clean(rows).select(*IDENTITY).distinct()
    known = bank.select(*[F.col(c).alias(f"__{c}") for c in IDENTITY])
    # A key may be NULL, and is known then too.
    missing = found.join(known, [found[c].eqNullSafe(F.col(f"__{c}")) for c in IDENTITY], "left_anti")
    return missing.select(
        entry_id(*[F.col(c) for c in IDENTITY]).alias("id"), *IDENTITY,
        F.lit(1).cast("long").alias("use_count"), now.alias("last_used_at"), now.alias("created_at"))


def record_ensure(bank: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Insert missing values; counts and times of known ones stay as they are."""
    return bank.select(*BANK_COLUMNS).unionByName(missing_values(bank, rows, now))


def ensure_categories(existing: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Categories (id, name, source_key, created_at) extended by the names of ``rows``.

    ``rows`` has category, key_name and a position ``pos``; the first spelling of a name is kept.
    """
    first = F.min_by(F.struct(category_name(F.col("category")).alias("name"),
                              F.coalesce("source_key", "key_name").alias("source_key")), F.col("pos"))
    source = rows if "source_key" in rows.columns else rows.withColumn("source_key", F.lit(None).cast("string"))
    found = source.groupBy(category_id(F.col("category")).alias("id")).agg(first.alias("first"))
    added = found.join(existing.select("id"), "id", "left_anti").select(
        "id", "first.name", "first.source_key", now.alias("created_at"))
    return existing.select("id", "name", "source_key", "created_at").unionByName(added)


def prune_categories(categories: DataFrame, bank: DataFrame) -> DataFrame:
    return categories.join(bank.select(F.col("category_id").alias("id")).distinct(), "id", "left_semi")


# -- reading ------------------------------------------------------------------------------
def with_category(bank: DataFrame, categories: DataFrame) -> DataFrame:
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return bank.join(names, "category_id", "left").withColumn(
        "category_name", F.coalesce("category_name", F.lit(UNCATEGORIZED)))


def suggest(bank: DataFrame, *, category: str | None = None, key: str | None = None,
            prefix: str | None = None, limit: int = 20) -> DataFrame:
    """Most used values, optionally of a category, a key or with a literal prefix."""
    out = bank
    if (category or "").strip():
        out = out.where(F.col("category_id") == category_id(F.lit(category)))
    if (key or "").strip():
        out = out.where(F.lower("key_name") == key.strip().lower())
    if (prefix or "").strip():
        out = out.where(F.startswith(F.lower("value"), F.lit(prefix.strip().lower())))
    return out.orderBy(F.desc("use_count"), F.desc("last_used_at"), "id").limit(at_least_one(limit))


def _newest(bank: DataFrame) -> DataFrame:
    return bank.orderBy(F.desc("last_used_at"), F.desc("id"))


def recent(bank: DataFrame, categories: DataFrame, limit: int = 50) -> DataFrame:
    """Newest entries; the category name is looked up for the listed rows only."""
    return with_category(_newest(bank).limit(at_least_one(limit)), categories)


def matches(text: str) -> Column:
    """Literal, case-insensitive substring test on key, value and category name."""
    needle = F.lit(text.strip().lower())
    return (F.contains(F.lower("key_name"), needle) | F.contains(F.lower("value"), needle)
            | F.contains(F.lower("category_name"), needle))


def search(bank: DataFrame, categories: DataFrame, text: str) -> DataFrame:
    named = with_category(bank, categories)
    return named.where(matches(text)) if text.strip() else named


#: Entries that a page may lie behind before its range is looked for; every task of a sorted cut sends so many.
PAGE_DEPTH = 100_000


def _range_of(found: DataFrame, offset: int, size: int) -> tuple[DataFrame, int]:
    """The entries among which a page of the newest lies, and its offset in them.

    Counts per hour, then per second, then per beginning of the id (until there are few, or the page spans several) tell which
    range holds the page; only that range is sorted.
    """
    at = F.coalesce("last_used_at", F.lit("0001-01-01").cast("timestamp_ntz"))
    for level in (F.date_trunc("hour", at), F.date_trunc("second", at), F.left("id", F.lit(4))):
        sizes = found.groupBy(level.alias("part")).agg(F.count("*").alias("n"))
        newer = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
        sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(newer), F.lit(0)))
        r = sizes.where((F.col("before") + F.col("n") > offset) & (F.col("before") < offset + size)).agg(
            F.min("part").alias("low"), F.max("part").alias("high"), F.min("before").alias("before"), F.sum("n").alias("n")).first()
        if r["n"] is None:
            return found.limit(0), 0
        found, offset = found.where((level >= F.lit(r["low"])) & (level <= F.lit(r["high"]))), offset - r["before"]
        if r["low"] != r["high"] or r["n"] <= PAGE_DEPTH:
            break
    return found, offset


def page(bank: DataFrame, categories: DataFrame, offset: int = 0, limit: int = 100,
         text: str = "") -> tuple[DataFrame, DataFrame]:
    """(page of entries, one-row total).  A page past the end is empty."""
    found = search(bank, categories, text) if text.strip() else bank
    size, skip = at_least_one(limit), max(0, int(offset))
    part, left = _range_of(found, skip, size) if skip + size > PAGE_DEPTH else (found, skip)
    items = _newest(part).offset(left).limit(size)
    # Without a text the category is looked up for the listed rows only.
    return items if text.strip() else with_category(items, categories), found.agg(F.count("*").alias("total"))


def _ranked(bank: DataFrame, keep: int) -> DataFrame:
    """Rank of each value within its key, best first, cut to ``keep``.

    The cut is a plain ``row_number() <= keep``: Spark applies it in every task before the
    shuffle, so even a key with most of the bank sends only ``keep`` rows per task.
    """
    order = W.partitionBy("key").orderBy(F.desc("use_count"), F.desc("last_used_at"), "value")
    own = bank.withColumn("key", F.lower("key_name")).where(F.col("category_id") == category_id(F.col("key_name")))
    return own.select("key", "value", "use_count", "last_used_at",
                      F.row_number().over(order).alias("rank")).where(F.col("rank") <= keep)


def values_for_key(bank: DataFrame, limit: int = VALUES_PER_KEY) -> DataFrame:
    """(key, rank, value) of every key, ranked by use and time."""
    return _ranked(bank, limit).select("key", "rank", "value")


def values_for_keys(bank: DataFrame, keys: Sequence[str], limit: int = VALUES_PER_KEY) -> DataFrame:
    """Values of several keys in key order; a value counts where it occurs first."""
    wanted = list(dict.fromkeys(k.strip().lower() for k in keys if k.strip()))
    position = F.array_position(F.lit(wanted), F.col("key"))
    ranked = _ranked(bank.where(F.lower("key_name").isin(wanted)), limit)
    place = F.struct(position.alias("key_pos"), F.col("rank"))
    return (ranked.groupBy("value").agg(F.min(place).alias("place"))
            .orderBy("place").limit(limit).select("value", "place.key_pos", "place.rank"))


def bank_for_fields(bank: DataFrame, schema: Schema, limit: int = VALUES_PER_KEY) -> dict[str, list[str]]:
    """The best ``limit`` values of every read key of the schema, for the driver-side compile."""
    keys = sorted({k.lower() for path, f in schema.leaves() for k in f.read_keys(path)})
    rows = values_for_key(bank.where(F.lower("key_name").isin(keys)), limit).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["key"], r["rank"])):
        out.setdefault(r["key"], []).append(r["value"])
    return out


def keys(bank: DataFrame, prefix: str, limit: int = 30) -> DataFrame:
    """Keys, then leaf names of nested keys, that start with the prefix."""
    low = prefix.strip().lower()
    names = bank.select("key_name").distinct()
    both = names.select(F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.col("key_name").alias("name")),
        F.struct(F.lit(1).alias("pos"), F.substring_index("key_name", ".", -1).alias("name")))).alias("k"))
    return (both.select("k.*").where(F.startswith(F.lower("name"), F.lit(low)))
            .groupBy("name").agg(F.min("pos").alias("pos"))
            .orderBy("pos", "name").limit(at_least_one(limit)).select("name"))


def top_keys(bank: DataFrame, limit: int = 30) -> DataFrame:
    return (bank.groupBy("key_name").agg(F.sum("use_count").alias("uses"))
            .orderBy(F.desc("uses"), "key_name").limit(at_least_one(limit)))


# -- deleting -----------------------------------------------------------------------------
def clear_condition(mode: str, *, now: datetime | None = None, days: int | None = None,
                    cutoff: datetime | None = None, age: str | None = None) -> Column:
    """Which rows a clear request removes: newer is ``>=`` the cutoff, older strictly before it."""
    if mode == "all":
        return F.lit(True)
    if mode == "days":
        if days is None or not 1 <= int(days) <= MAX_CLEAR_DAYS:
            raise ValueError(f"days must be between 1 and {MAX_CLEAR_DAYS}")
        cutoff, age = (now or datetime.now(timezone.utc).replace(tzinfo=None)) - timedelta(days=int(days)), age or "newer"
    elif mode == "datetime":
        if cutoff is None:
            raise ValueError("a cutoff is required")
        age = age or "older"
    else:
        raise ValueError(f"unknown clear mode {mode!r}")
    if age not in ("newer", "older"):
        raise ValueError("age must be 'newer' or 'older'")
    at = F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")
    stamp = F.col("last_used_at").cast("timestamp_ntz")
    return stamp >= at if age == "newer" else stamp < at


def clear(bank: DataFrame, mode: str, *, confirm: bool = False, **request) -> DataFrame:
    if mode == "all" and not confirm:
        raise ValueError("clearing the whole bank must be confirmed")
    return bank.where(~clear_condition(mode, **request))


def count_clear(bank: DataFrame, mode: str, **request) -> DataFrame:
    return bank.where(clear_condition(mode, **request)).agg(F.count("*").alias("rows"))


def delete_ids(bank: DataFrame, ids: DataFrame | Iterable[str]) -> DataFrame:
    """Drop entries by id; a large id set is passed as a frame with a column ``id``."""
    if not isinstance(ids, DataFrame):
        listed = [(i,) for i in {str(i).strip() for i in ids} if i]
        ids = bank.sparkSession.createDataFrame(listed, "id string")
    return bank.join(ids.select(trim(F.col("id")).alias("id")).where("id <> ''").distinct(), "id", "left_anti")


def delete_matching(bank: DataFrame, categories: DataFrame, text: str) -> DataFrame:
    if not text.strip():
        raise ValueError("a search text is required")
    return with_category(bank, categories).where(~matches(text)).select(*BANK_COLUMNS)


# -- correcting ---------------------------------------------------------------------------
def correct(bank: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """Apply (id, value) edits; an edit that meets an existing value of its key merges into it.

    All edits of a call apply to the bank as it was.  Only the edited entries and the entries
    they meet are grouped; the rest of the bank passes through.
    """
    value = trim(F.col("new_value"))
    wanted = (edits.select("id", F.col("value").alias("new_value")).withColumn("new_value", value)
              .where("new_value <> ''").groupBy("id").agg(F.min("new_value").alias("new_value")))
    changed = (bank.join(wanted, "id").where("new_value <> value")
               .withColumns({"value": F.col("new_value"), "last_used_at": now, "edited": F.lit(1)})
               .select(*BANK_COLUMNS, "edited"))
    rest = bank.join(changed.select("id"), "id", "left_anti")
    targets = changed.select(*IDENTITY).distinct()
    met = rest.join(targets, IDENTITY, "left_semi").select(*BANK_COLUMNS, F.lit(0).alias("edited"))
    keep = F.min_by(F.struct("id", "created_at"), F.struct("edited", "id"))
    merged = (changed.unionByName(met).groupBy(*IDENTITY)
              .agg(keep.alias("kept"), F.sum("use_count").alias("use_count"),
                   F.max(F.when(F.col("edited") == 1, F.col("last_used_at"))).alias("last_used_at"))
              .select("kept.id", *IDENTITY, "use_count", "last_used_at", "kept.created_at"))
    return rest.join(targets, IDENTITY, "left_anti").select(*BANK_COLUMNS).unionByName(merged)


# -- transfer -----------------------------------------------------------------------------
def _recent_enough(bank: DataFrame, rows: int) -> DataFrame:
    """The bank without hours that cannot hold any of the newest ``rows`` entries.

    A large top-k would make every task send up to k rows to one; the counts per hour tell which
    hours are needed, at the price of one aggregation over a single column.
    """
    hours = bank.groupBy(F.date_trunc("hour", "last_used_at").alias("hour")).agg(F.count("*").alias("n"))
    newer = W.orderBy(F.desc("hour")).rowsBetween(W.unboundedPreceding, -1)
    needed = hours.withColumn("before", F.coalesce(F.sum("n").over(newer), F.lit(0))).where(F.col("before") < rows)
    oldest = needed.agg(F.min("hour")).first()[0]
    return bank if oldest is None else bank.where(F.col("last_used_at") >= F.lit(oldest))


def snapshot(bank: DataFrame, categories: DataFrame, limit: int | None = None) -> DataFrame:
    """All entries, or the newest ``limit``, with their category, for transfer to another bank."""
    if limit is None:
        return with_category(bank, categories)
    limit = at_least_one(limit)
    return with_category(_newest(_recent_enough(bank, limit)).limit(limit), categories)


def restore(bank: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Take over snapshot rows (category_name, key_name, value); known values stay untouched."""
    category, key = trim(F.coalesce("category_name", F.lit(""))), trim(F.coalesce("key_name", F.lit("")))
    filled = rows.select(
        F.coalesce(F.nullif(category, F.lit("")), F.nullif(key, F.lit(""))).alias("category"),
        F.coalesce(F.nullif(key, F.lit("")), F.nullif(category, F.lit(""))).alias("key_name"), "value")
    return record_ensure(bank, filled.where("category IS NOT NULL"), now)


def counts(**stores: DataFrame) -> DataFrame:
    """(store, rows) of each named frame."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("store"), "rows")
             for name, df in stores.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_cap(n: int) -> int:
    """Bank rows one run may add."""
    return min(max(20 * max(n, 1), 200), 5000)
