"""Best-fit packing of token pieces, after Martello and Toth's dominance reduction.

Pieces of one length are alike, so the instance is the count of pieces of each length: at most ``capacity`` numbers,
however many documents there are.  The reduction takes a length w and the pieces that fit beside it.  If one set of
partners dominates every other set that could share a sequence with w (each piece of the other set fits into a place of
its own in the dominating one), that sequence belongs to some optimal packing and is fixed, as many times as the counts
allow.  What no rule fixes is packed best-fit decreasing.  Both work on counts, on the driver.

Back on the cluster, a piece's rank among those of its length decides its place.  Ranks come from row numbers in small
hashed groups plus the sizes of the groups before, so a length that most pieces share is spread over all tasks.

A null text counts as empty (its end token alone is packed), repeated rows are packed one by one, other columns are left
out, an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window as W, functions as F

from synthmill.llm.common import narrowed, slices, written

CAPACITY = 1024
END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def byte_symbols() -> dict[str, int]:
    """The characters that byte-level vocabulary files write for bytes: printable Latin-1 as itself, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers JSON file.

    Its ids run in merge order (checked here), so encoding by lowest rank gives the ids that the tokenizers library
    gives, several times faster.
    """
    if (path, pattern) not in _encodings:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocab, symbols = data["model"]["vocab"], byte_symbols()
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in data["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError(f"{path}: ids are not in merge order")
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token not in special}
        _encodings[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encodings[path, pattern]


def piece_lengths(n: int, capacity: int) -> list[int]:
    """A document that fits is one piece; a longer one is cut so that only its first piece may be short."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document's ids and end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for ids, texts in slices(batch):
                rows: list[tuple] = []
                for doc, text in zip(ids, texts, strict=True):
                    tokens = np.array(enc.encode(text or "", allowed_special="all") + [end], "<u4")
                    start = 0
                    for k, n in enumerate(piece_lengths(len(tokens), capacity)):
                        rows.append((doc, k, start, n, zlib.crc32(tokens[start:start + n].tobytes())))
                        start += n
                doc, k, start, n, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(k, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return narrowed(docs, id_col, text_col).mapInArrow(run, PIECES)


class Instance:
    """Counts of the lengths that are still to be packed, and the sequences made so far as (lengths, how often)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {w: n for w, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)
        self.made: list[tuple[list[int], int]] = []

    def largest(self, limit: int, beside: tuple[int, ...] = ()) -> int | None:
        """Largest length up to ``limit`` of which a piece is left besides those in ``beside``."""
        at = bisect_right(self.sizes, limit)
        while at:
            at -= 1
            if self.left[self.sizes[at]] > beside.count(self.sizes[at]):
                return self.sizes[at]
        return None

    def smallest(self, n: int, beside: int) -> int | None:
        """Sum of the n smallest pieces besides one of length ``beside``; None if there are fewer."""
        total = 0
        for w in self.sizes:
            take = min(n, self.left[w] - (w == beside))
            total, n = total + take * w, n - take
            if not n:
                return total
        return None

    def fix(self, lengths: list[int]) -> None:
        """Make this sequence as often as the counts allow."""
        often = min(self.left[w] // lengths.count(w) for w in set(lengths))
        self.made.append((lengths, often))
        for w in lengths:
            self.left[w] -= often
        for w in set(lengths):
            if not self.left[w]:
                del self.left[w]
                del self.sizes[bisect_left(self.sizes, w)]

    def dominating(self, w: int) -> list[int] | None:
        """The set with w that dominates all others with w, if a rule proves one."""
        room = self.capacity - w
        one = self.largest(room, (w,))
        if one is None:
            return [w]
        two = self.smallest(2, w)
        # All partners together fit into the place of one that fills the room, or there is but one partner.
        if one == room or two is None or two > room:
            return [w, one]
        three = self.smallest(3, w)
        if three is not None and three <= room:
            return None
        # At most two partners: pairs have a smaller part of at most half the room.
        half = self.largest(room // 2, (w,))
        other = self.largest(room - one, (w, one))
        if other is not None and half is not None and other >= half:
            return [w, one, other]
        return None

    def reduce(self) -> None:
        """Fix dominating sets until no length has one.  Every fixing uses a length up, so there are few."""
        again = True
        while again:
            again = False
            for w in reversed(list(self.sizes)):
                while w in self.left and (lengths := self.dominating(w)):
                    self.fix(lengths)
                    again = True

    def best_fit(self) -> None:
        """Longest first, each into the open sequence with the least room that holds it; alike sequences move together."""
        open_by_room: dict[int, list[tuple[list[int], int]]] = {}
        rooms: list[int] = []

        def put(lengths: list[int], often: int) -> None:
            room = self.capacity - sum(lengths)
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append((lengths, often))

        for w in reversed(self.sizes):
            n = self.left[w]
            while n:
                at = bisect_left(rooms, w)
                if at == len(rooms):
                    per = self.capacity // w
                    if n >= per:
                        put([w] * per, n // per)
                    if n % per:
                        put([w] * (n % per), 1)
                    break
                group = open_by_room[rooms[at]]
                lengths, often = group.pop()
                if not group:
                    del open_by_room[rooms.pop(at)]
                take = min(n, often)
                put([*lengths, w], take)
                if often > take:
                    put(lengths, often - take)
                n -= take
        self.made += [x for group in open_by_room.values() for x in group]
        self.left, self.sizes = {}, []


def packed_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Sequences as (lengths, how often) for so many pieces of each length."""
    instance = Instance(counts, capacity)
    instance.reduce()
    instance.best_fit()
    return instance.made


def places(made: list[tuple[list[int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length, runs of ranks as (first rank, number, first sequence, offset)."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, often in made:
        offset = 0
        for w in lengths:
            runs.setdefault(w, []).append((used.get(w, 0), often, sequence, offset))
            used[w] = used.get(w, 0) + often
            offset += w
        sequence += often
    return runs


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (rows of ``pieces``, read more than once) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    runs = places(packed_lengths(counts, capacity))
    # At most one row a length; the number of runs depends on the capacity, not on the documents.
    plan = spark.createDataFrame([(w, [tuple(x) for x in xs]) for w, xs in runs.items()],
                                 "length long, runs array<struct<first:long,n:long,sequence:long,offset:long>>")
    groups = math.isqrt(sum(counts.values())) + 1  # as many groups as pieces in a group, should all have one length
    keyed = cut.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = W.partitionBy("length").orderBy("__group").rowsBetween(W.unboundedPreceding, -1)
    sizes = keyed.groupBy("length", "__group").agg(F.count("*").alias("__n"))
    sizes = sizes.select("length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("length", "__group").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = keyed.withColumn("__inside", inside).join(sizes, ["length", "__group"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__inside") - 1)
    placed = ranked.join(F.broadcast(plan), "length").withColumn(
        "__run", F.expr("filter(runs, r -> r.first <= __rank AND __rank < r.first + r.n)[0]"))
    return placed.select(*cut.columns, F.expr("__run.sequence + __rank - __run.first").alias("sequence_id"),
                         F.col("__run.offset").alias("offset"))


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its place there; texts are encoded once, ids are not moved."""
    return packed(written(pieces(docs, path, pattern, capacity, end, id_col, text_col), "pieces"), capacity)
