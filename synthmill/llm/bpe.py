"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Leaf i of the tree holds the rank of the pair that starts at byte i (none: a value above all ranks); a node holds the
smaller of its children, the left one on ties, so the root names the leftmost pair of lowest rank.  A merge gives the
right part's place up and updates three leaves (the merged token, its left neighbour, the lost one) up to the root: a
text piece of n bytes takes n log n steps.

Short pieces are encoded many at a time, one tree per column of an array; long ones alone.  Pieces seen before are looked
up in a table of bounded size; who wants numbers of tokens only has a table of numbers, and no ids or bytes are made.  A null
text counts as empty and has no tokens; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from synthmill.llm.common import narrowed, slices

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pieces remembered by a worker; half of them are dropped when it is full.
REMEMBERED = 400_000
#: Pieces whose number of tokens alone is remembered: no ids and bytes are kept for them.
COUNTED = 800_000
#: Longest piece, in bytes, that is encoded together with others, and so many at a time.
TOGETHER = 64
ROWS = 2_000


class Vocabulary:
    """Ranks of byte strings, and of the pairs that make them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.parts = {rank: token for token, rank in ranks.items()}
        self.none = max(ranks.values(), default=0) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.none + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.byte_list = self.byte_ids.tolist()
        #: Rank of each pair of bytes, at 256 * left + right.
        self.byte_pairs = self.pair_ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.none + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.none)


def encode_one(voc: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one piece of any length."""
    n = len(piece)
    ids = voc.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    if n < 2:
        return ids
    width = 1 << (n - 1).bit_length()
    none, pairs, stride = voc.none, voc.pairs, voc.none
    tree = [none] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = pairs.get(ids[i] * stride + ids[i + 1], none)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        i += width
        tree[i] = rank
        i >>= 1
        while i:
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    while (rank := tree[1]) < none:
        i = 1
        while i < width:
            i = 2 * i if tree[2 * i] == rank else 2 * i + 1
        i -= width
        lost = after[i]
        ids[i], ids[lost] = rank, -1
        nxt, prev = after[lost], before[i]
        after[i] = nxt
        if nxt < n:
            before[nxt] = i
        put(lost, none)
        put(i, pairs.get(rank * stride + ids[nxt], none) if nxt < n else none)
        if prev >= 0:
            put(prev, pairs.get(ids[prev] * stride + rank, none))
    return [x for x in ids if x >= 0]


def merged_together(voc: Vocabulary, pieces: list[bytes], width: int) -> np.ndarray:
    """Ids of pieces of at most ``width`` (a power of two) bytes, -1 at lost places: one tree per column, all columns merge in step.

    A node holds rank * width + place, so a root names the place too.  Inner nodes are computed level by level for all columns:
    as contiguous rows they cost less than the paths from the changed leaves, which would have to be gathered.
    """
    n, none, shift = len(pieces), voc.none, width.bit_length() - 1
    length = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width).T.astype(np.int64, order="C")
    place = np.arange(width)[:, None]
    over = none << shift
    ids = np.where(place < length, voc.byte_ids[raw], -1)
    tree = np.full((2 * width, n), over, np.int64)
    tree[width:-1] = np.where(place[:-1] < length - 1, (voc.byte_pairs[(raw[:-1] << 8) + raw[1:]] << shift) + place[:-1], over)
    after = np.repeat(place + 1, n, 1).ravel()
    before = np.repeat(place - 1, n, 1).ravel()
    # Flat views: place i of column c is i * n + c.
    flat, leaves = ids.ravel(), tree[width:].ravel()
    while True:
        level = width
        while level > 1:
            np.minimum(tree[level:2 * level:2], tree[level + 1:2 * level:2], out=tree[level >> 1:level])
            level >>= 1
        live = np.flatnonzero(tree[1] < over)
        if not len(live):
            return ids
        low = tree[1, live]
        rank, i = low >> shift, low & (width - 1)
        at = i * n + live
        lost = after[at] * n + live
        nxt, prev = after[lost], before[at]
        flat[at] = rank
        flat[lost] = -1
        after[at] = nxt
        leaves[at] = over
        leaves[lost] = over
        has = np.flatnonzero(nxt < length[live])
        right = nxt[has] * n + live[has]
        before[right] = i[has]
        leaves[at[has]] = (voc.pair_ranks(rank[has], flat[right]) << shift) + i[has]
        has = np.flatnonzero(prev >= 0)
        left = prev[has] * n + live[has]
        leaves[left] = (voc.pair_ranks(flat[left], rank[has]) << shift) + prev[has]


def encode_together(voc: Vocabulary, pieces: list[bytes], width: int) -> list[list[int]]:
    """Ids of pieces of at most ``width`` (a power of two) bytes."""
    return [[x for x in row if x >= 0] for row in merged_together(voc, pieces, width).T.tolist()]


def count_short(voc: Vocabulary, piece: bytes) -> int:
    """Number of ids of one piece of a few bytes, whose pairs are soon looked through."""
    none, pairs, stride = voc.none, voc.pairs, voc.none
    ids = [voc.byte_list[b] for b in piece]
    ranks = [pairs.get(a * stride + b, none) for a, b in zip(ids, ids[1:])]
    while ranks and (rank := min(ranks)) < none:
        i = ranks.index(rank)
        ids[i] = rank
        del ids[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = pairs.get(rank * stride + ids[i + 1], none)
        if i:
            ranks[i - 1] = pairs.get(ids[i - 1] * stride + rank, none)
    return len(ids)


def room(table: dict, new: set[str], limit: int, wanted: Container[str] = ()) -> None:
    """Halve the table if ``new`` would make it outgrow ``limit``; what is wanted stays."""
    if len(table) + len(new) > limit:
        for piece in list(table)[:len(table) // 2]:
            if piece not in wanted:
                del table[piece]


class Encoder:
    """Pieces to ids, with a table of pieces seen before; and to numbers of ids, with a table of its own."""

    def __init__(self, voc: Vocabulary, pattern: str):
        self.voc, self.split = voc, regex.compile(pattern).findall
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.counts: dict[str, int] = {}

    def dealt(self, pieces: list[str]) -> Iterator[tuple[int, list[str], list[bytes]]]:
        """Pieces and their bytes, so many at a time, by the width they are encoded with together; 0: alone."""
        raws = list(map(str.encode, pieces))
        widths = [2 << i for i in range(TOGETHER.bit_length() - 1)]
        kind = np.searchsorted(widths, np.fromiter(map(len, raws), np.int64, len(raws)))
        for k, width in enumerate([*widths, 0]):
            some = np.flatnonzero(kind == k).tolist()
            for start in range(0, len(some), ROWS):
                part = some[start:start + ROWS]
                yield width, [pieces[i] for i in part], [raws[i] for i in part]

    def learn(self, pieces: list[str]) -> None:
        for width, part, raws in self.dealt(pieces):
            found = encode_together(self.voc, raws, width) if width else [encode_one(self.voc, raw) for raw in raws]
            for piece, ids in zip(part, found, strict=True):
                self.known[piece] = (",".join(map(str, ids)), len(ids), b"".join(map(self.voc.parts.__getitem__, ids)))

    def learn_counts(self, pieces: list[str]) -> None:
        for width, part, raws in self.dealt(pieces):
            found = (merged_together(self.voc, raws, width) >= 0).sum(0).tolist() if width else [len(encode_one(self.voc, raw)) for raw in raws]
            self.counts.update(zip(part, found, strict=True))

    def prepare(self, cut: list[list[str]]) -> None:
        """Know all pieces of these lists."""
        wanted = set().union(*cut)
        new = wanted - self.known.keys()
        room(self.known, new, REMEMBERED, wanted)
        self.learn(list(new))

    def counted(self, texts: list[str | None]) -> list[tuple[list[str], list[int]]]:
        """For each text, its pieces and the tokens of each.  Pieces are looked up as soon as they are cut; those the table lacks, all together."""
        rows, holes, new = [], [], set()
        look = self.counts.get
        for text in texts:
            pieces = self.split(text or "")
            numbers = list(map(look, pieces))
            gaps = [i for i, n in enumerate(numbers) if n is None] if None in numbers else []
            new.update(map(pieces.__getitem__, gaps))
            rows.append((pieces, numbers))
            holes.append(gaps)
        room(self.counts, new, COUNTED)
        self.learn_counts(list(new))
        for (pieces, numbers), gaps in zip(rows, holes, strict=True):
            for i in gaps:
                numbers[i] = look(pieces[i])
        return rows

    def count(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece."""
        try:
            return list(map(self.counts.__getitem__, pieces))
        except KeyError:  # an edit has made a new piece or two: not worth a batch
            return [self.lone(p) for p in pieces]

    def lone(self, piece: str) -> int:
        """Tokens of a piece; a new one is encoded alone, and kept if it is short and the table has room."""
        n = self.counts.get(piece)
        if n is None:
            raw = piece.encode()
            if len(raw) > TOGETHER:
                return len(encode_one(self.voc, raw))
            n = count_short(self.voc, raw)
            if len(self.counts) < COUNTED:
                self.counts[piece] = n
        return n

    def encode(self, texts: list[str | None]) -> list[list[tuple[str, int, bytes]]]:
        """For each text, its pieces as (ids joined by commas, their number, their bytes)."""
        cut = [self.split(t or "") for t in texts]
        self.prepare(cut)
        look = self.known.__getitem__
        return [list(map(look, pieces)) for pieces in cut]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This worker's encoder for a rank file; it serves later tasks too."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(Vocabulary.read(path), pattern)
    return _encoders[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of tokens, digest of the ids, digest of the decoded bytes.

    ``path`` is a rank file at the same place on every machine, as an installed package puts it there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for ids, texts in slices(batch):
                rows = enc.encode(texts)
                sha = lambda parts: hashlib.sha256(parts).hexdigest()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()),
                    "n_tokens": pa.array([sum(p[1] for p in row) for row in rows], pa.int64()),
                    "ids_sha256": pa.array([sha(",".join([p[0] for p in row]).encode()) for row in rows], pa.string()),
                    "decoded_sha256": pa.array([sha(b"".join([p[2] for p in row])) for row in rows], pa.string())})

    return narrowed(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def token_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for ids, texts in slices(batch):
                rows = [[int(x) for p in row for x in p[0].split(",")] for row in enc.encode(texts)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(rows, pa.list_(pa.int32()))})

    return narrowed(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) back to (doc_id, raw bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = encoder(path, pattern).voc.parts
        for batch in batches:
            raw = [b"".join(parts[i] for i in ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "raw": pa.array(raw, pa.binary())})

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")

