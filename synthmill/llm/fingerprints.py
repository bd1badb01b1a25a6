"""Document fingerprints by content-defined chunking.

A gear hash runs over the bytes of a text; a chunk ends where its top bits are zero.  Chunking is normalised: up to the
normal size a rarer boundary is asked for, beyond it a more frequent one, so that sizes stay near the normal one.  No
boundary lies within the least size of the one before, which is the length of the hash's memory: boundaries depend on
nothing but the bytes just before them, and text that moves keeps its chunks.

A fingerprint is the set of chunk digests, each with the bytes it stands for.  The containment of one in another is the
share of its bytes whose chunks the other has too.

A null text counts as empty; the empty text has the empty fingerprint, contained in itself only.  Repeated keys are
ordered by text, null keys come last.  Other columns are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from synthmill.llm.common import narrowed, rows_of

#: Sizes in bytes; the least is also the memory of the 32-bit gear hash.
LEAST, NORMAL, MOST = 32, 64, 256
#: Zero bits of a boundary before and after the normal size.
RARE_BITS, FREQUENT_BITS = 7, 5
#: Keys in a group that one task orders: 2**10.
GROUP_BITS = 10

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_chunks long")


def gear_table() -> np.ndarray:
    """256 numbers of 32 bits, from a counter by the SplitMix rule."""
    mask, state, out = (1 << 64) - 1, 0, []
    for _ in range(256):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append((z ^ (z >> 31)) >> 32)
    return np.array(out, np.uint32)


GEAR = gear_table()


def gear_hashes(data: bytes) -> np.ndarray:
    """The hash after each byte: the sum of the last 32 bytes' numbers, each shifted by its distance."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # sums over 1, 2, 4, ... bytes; after 32 the shift leaves nothing
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(data)
    frequent = np.flatnonzero(h >> np.uint32(32 - FREQUENT_BITS) == 0)
    rare = (frequent[h[frequent] >> np.uint32(32 - RARE_BITS) == 0] + 1).tolist()
    frequent = (frequent + 1).tolist()
    ends, start = [], 0
    while n - start > LEAST:
        end = min(start + MOST, n)
        at = bisect_left(rare, start + LEAST)
        if at < len(rare) and rare[at] < start + NORMAL:
            end = min(end, rare[at])
        else:
            at = bisect_left(frequent, start + NORMAL)
            if at < len(frequent):
                end = min(end, frequent[at])
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def fingerprint(data: bytes) -> dict[int, int]:
    """Bytes by chunk digest."""
    weights: dict[int, int] = {}
    start = 0
    for end in boundaries(data):
        digest = xxhash.xxh3_64_intdigest(data[start:end])
        weights[digest] = weights.get(digest, 0) + end - start
        start = end
    return weights


def spelled(weights: dict[int, int]) -> str:
    return ",".join([f"{d:016x}:{n}" for d, n in sorted(weights.items())])


def containment(part: dict[int, int], whole: dict[int, int]) -> float:
    """Share of the bytes of ``part`` that ``whole`` has."""
    if not part:
        return 0.0 if whole else 1.0
    return sum(min(n, whole.get(d, 0)) for d, n in part.items()) / sum(part.values())


def before(keys: DataFrame, key: str, bits: int = 64) -> DataFrame:
    """Distinct whole numbers of column ``key`` with ``before``: the next smaller one (null for the smallest).

    No task orders more than 2**16 of them: each group of 2**16 numbers finds its own, and the smallest of a group takes
    the largest of the group before, which is the same question about the groups.
    """
    if bits <= 16:
        return keys.select(key, F.lag(key).over(W.orderBy(key)).alias("before"))
    group = f"__group{bits}"
    grouped = keys.withColumn(group, F.shiftright(F.col(key), 16))
    inside = grouped.withColumn("__inside", F.lag(key).over(W.partitionBy(group).orderBy(key)))
    groups = before(grouped.select(group).distinct(), group, bits - 16)
    ends = grouped.groupBy(F.col(group).alias("before")).agg(F.max(key).alias("__max"))
    groups = groups.join(ends, "before").select(group, "__max")
    return inside.join(groups, group, "left").select(key, F.coalesce("__inside", "__max").alias("before"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the text of the next smaller key; the smallest has the largest's, one document its own.

    Texts move once, into groups of neighbouring keys, and both uses read that exchange; besides, the first text of each
    group goes to the group above, the topmost's to the lowest.
    """
    nulls = -(1 << 60)  # below all groups
    group = F.coalesce(F.shiftright("doc_id", GROUP_BITS), F.lit(nulls)).alias("group")
    keys = docs.select(group).distinct()
    top = keys.agg(F.max("group")).first()[0]
    down = W.partitionBy("group").orderBy(F.col("doc_id").desc(), F.col("text").desc())
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), group).withColumns(
        {"__next": F.lead("text").over(down), "__place": F.row_number().over(down)})
    firsts = ordered.filter("__place = 1").select(F.col("group").alias("at"), F.col("text").alias("first_text"))
    links = before(keys, "group").select("group", F.coalesce("before", F.lit(top)).alias("at"))
    links = links.join(firsts, "at").select("group", "first_text")
    return ordered.join(links, "group").select("doc_id", "text", F.coalesce("__next", "first_text").alias("next_text"))


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many characters of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how far they and the next one's agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_text, kept = None, {}
        for batch in batches:
            rows, size = [], 0
            for doc, text, following in rows_of(batch):
                own = kept if text == kept_text else fingerprint(text.encode())
                kept_text, kept = following, fingerprint(following.encode())  # mostly the next row's own
                other = edited(text, following)
                raw = other.encode()
                changed = fingerprint(raw)
                rows.append((doc, len(text), hashlib.sha256(raw).hexdigest(), spelled(own), spelled(changed),
                             containment(own, changed), containment(own, kept), len(own)))
                size += len(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCHEMA.split(", ")])
    names = schema.names
    return with_next(narrowed(docs, id_col, text_col)).mapInArrow(run, SCHEMA)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its chunks as an array of (digest, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("digest", pa.string()), ("bytes", pa.int64())]))
        for batch in batches:
            sets = [fingerprint((t or "").encode()) for t in batch.column(1).to_pylist()]
            rows = [[{"digest": f"{d:016x}", "bytes": n} for d, n in sorted(s.items())] for s in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "chunks": pa.array(rows, kind)})

    return narrowed(docs, id_col, text_col).mapInArrow(run, "doc_id long, chunks array<struct<digest:string,bytes:long>>")


def likeness(left: str, right: str) -> Column:
    """Containment of one ``chunks`` column in another, as an expression."""
    return F.expr(f"""CASE WHEN size({left}) = 0 THEN if(size({right}) = 0, 1.0D, 0.0D) ELSE
        aggregate({left}, 0L, (sum, part) -> sum + least(part.bytes, coalesce(get(filter({right}, other -> other.digest = part.digest), 0).bytes, 0L)))
        / aggregate({left}, 0L, (sum, part) -> sum + part.bytes) END""")
