"""Which keys of a block does another block have too?  Asked and answered in arrays, without a row per key.

A block is a bounded share of the documents, chosen by hash.  Each block sends every distinct key
once, with its count in the block, to the part of the key space that owns it; a part adds the counts up and tells each
block which of its keys reach two.  However many documents have a key, a part hears of it once per block.

Keys are 64-bit hashes.  Within a part, 32 further bits tell them apart; two keys that fall together only make a key seem
shared that is not, which the operators must (and do) allow for.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from synthmill.llm.common import written
from synthmill.session import small_batches

#: Bytes of text in a block, the unit that is routed between stages, and the session option that sets another number.  A
#: task holds a block, so this fits small executors; over many TB, blocks of 128 MB or more keep a block's keys for a part
#: in arrays of some hundreds.
BLOCK_BYTES, BLOCK_OPTION = 4 << 20, "spark.synthmill.blockBytes"
#: Copies of a text that may share a block whatever the number of rows; most texts whose copies are spread.
FEW_COPIES, MOST_SPREAD = 64, 1_000_000

ASKED = "part int, block int, keys array<int>, counts array<int>"
TOLD = "block int, part int, keys array<int>, totals array<int>"
_LOW = np.uint64(0xFFFFFFFF)


def in_blocks(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """``docs`` with their ``block``, and the number of blocks, at least the session's shuffle partitions.

    Copies of a text share a block, where they count once, unless they are very many: those are spread by key, and count
    once per block.  The texts to be spread are at most MOST_SPREAD, as each has more than that share of the rows.
    """
    small_batches(docs.sparkSession)
    text_hash = F.xxhash64(F.coalesce(text, F.lit("")))
    total, rows = docs.agg(F.sum(F.octet_length(text).cast("long")), F.count("*")).first()
    conf = docs.sparkSession.conf
    size = int(conf.get(BLOCK_OPTION, str(BLOCK_BYTES)))
    blocks = max(int(conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // size))
    many = max(FEW_COPIES, rows // MOST_SPREAD)
    spread = docs.groupBy(text_hash.alias("__hash")).count().filter(F.col("count") > many).select("__hash")
    spread = written(spread, "spread")
    out = docs.join(F.broadcast(spread), text_hash == F.col("__hash"), "left")
    by = F.when(F.col("__hash").isNull(), text_hash).otherwise(F.xxhash64(key))
    return out.withColumn("block", F.pmod(by, F.lit(blocks)).cast("int")).drop("__hash"), blocks


def codes(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part and 32 bits of each key in one number."""
    return ((keys % np.uint64(parts)) << np.uint64(32)) | ((keys // np.uint64(parts)) & _LOW)


def arrays(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Lists of 32-bit numbers: ``flat`` from each cut to the next."""
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.astype(np.uint32).view(np.int32)))


def asked(block: int, code: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Rows for sorted distinct codes of a block."""
    part = (code >> np.uint64(32)).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(code) else np.zeros(0, np.int64)
    cuts = np.r_[heads, len(code)]
    return pa.table({"part": pa.array(part[heads], pa.int32()), "block": pa.array(np.full(len(heads), block), pa.int32()),
                     "keys": arrays(code & _LOW, cuts), "counts": arrays(counts, cuts)})


def summed(code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with the sums of their counts."""
    order = np.argsort(code, kind="stable")
    code, counts = code[order], counts[order]
    heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[heads], np.add.reduceat(counts, heads) if len(code) else counts


def tell(table: pa.Table) -> pa.Table:
    """Answers of one part."""
    keys = table.column("keys").combine_chunks()
    flat = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    counts = table.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.int64)
    size = keys.value_lengths().to_numpy(zero_copy_only=False)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sums = np.add.reduceat(counts[order], heads)
    totals = np.empty(len(flat), np.int64)
    totals[order] = np.repeat(sums, np.diff(np.r_[heads, len(flat)]))
    keep = totals > 1
    row = np.repeat(np.arange(len(size)), size)[keep]
    some = np.unique(row)
    cuts = np.r_[np.searchsorted(row, some), len(row)]
    pick = pa.array(some)
    return pa.table({"block": table.column("block").take(pick), "part": table.column("part").take(pick),
                     "keys": arrays(flat[keep], cuts), "totals": arrays(np.minimum(totals[keep], 0x7FFFFFFF), cuts)})


def shared_keys(questions: DataFrame) -> DataFrame:
    """Rows of ASKED to rows of TOLD: the keys whose counts reach two in all."""
    return questions.groupBy("part").applyInArrow(tell, TOLD)


def told(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and totals that a block has been told."""
    keys = table.column("keys").combine_chunks()
    flat = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64)
    totals = table.column("totals").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.repeat(table.column("part").to_numpy().astype(np.uint64), keys.value_lengths().to_numpy(zero_copy_only=False))
    code = (part << np.uint64(32)) | flat
    order = np.argsort(code)
    return code[order], totals[order]


def looked_up(code: np.ndarray, known: np.ndarray, values: np.ndarray, otherwise: int) -> np.ndarray:
    """The value of each code, from sorted known ones."""
    if not len(known):
        return np.full(len(code), otherwise, np.int64)
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    return np.where(known[at] == code, values[at], otherwise)


def first_of_texts(ids: Iterable[int | None], texts: Iterable[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Distinct texts of a block: the smallest key of each (null: above all), its bytes, and the text of each row."""
    number: dict[str, int] = {}
    of = np.fromiter((number.setdefault(t or "", len(number)) for t in texts), np.int64)
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, of, key_array(ids))
    return least, [t.encode() for t in number], of


def key_array(ids: Iterable[int | None]) -> np.ndarray:
    return np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
