"""Edit-aware token counts.

The pre-tokens of a document are the leaves of a segment tree whose nodes hold sums of characters and of tokens; a leaf
covers a run of pre-tokens.  An edit finds its place by going down the sums of characters.  Encoding starts again a few
characters before it, where the split pattern can see no change, and ends as soon as a new pre-token ends where an old
one did; the leaves in between are replaced and the sums above them are updated.  All else is kept.

Edits of a document apply in turn, each to the text that the ones before it left; places beyond the end count as the end.
A null text counts as empty, null edits as none; repeated rows are counted one by one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from synthmill.llm.bpe import encoder

#: Pre-tokens in a leaf.
LEAF = 64
#: Characters beyond a match that the split pattern may look at.
SEEN = 3
EDITS = "array<struct<seq:int,start:long,length:long,insert:string>>"
SCHEMA = "doc_id long, n_tokens long, edited_n_tokens long, n_edits long, n_pretokens long, n_reencoded long"


class Tree:
    """Pre-tokens of one text with sums; ``count`` gives the tokens of pre-tokens, ``split`` the pre-tokens of a text.

    ``numbers`` are the tokens of ``pieces``, if known already.
    """

    def __init__(self, pieces: list[str], count: Callable[[list[str]], list[int]], split: Callable[[str], list[str]],
                 numbers: list[int] | None = None):
        self.count, self.split, self.reencoded = count, split, 0
        self.leaves = [pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        numbers = count(pieces) if numbers is None else numbers
        for i, leaf in enumerate(self.leaves):
            self.chars[self.width + i] = sum(map(len, leaf))
            self.tokens[self.width + i] = sum(numbers[i * LEAF:(i + 1) * LEAF])
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def put(self, i: int, leaf: list[str], tokens: int) -> None:
        """Replace a leaf; the sums above it change by the difference."""
        chars = sum(map(len, leaf)) - self.chars[self.width + i]
        tokens -= self.tokens[self.width + i]
        self.leaves[i] = leaf
        i += self.width
        while i:
            self.chars[i] += chars
            self.tokens[i] += tokens
            i >>= 1

    def find(self, at: int) -> tuple[int, int, int]:
        """Leaf, pre-token and its first character, of the pre-token that holds character ``at`` (or follows the last)."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        leaf = node - self.width
        if leaf >= len(self.leaves):
            leaf = len(self.leaves) - 1
            start = self.chars[1] - self.chars[self.width + leaf]
        k = 0
        pieces = self.leaves[leaf]
        while k < len(pieces) and at >= start + len(pieces[k]):
            start += len(pieces[k])
            k += 1
        return leaf, k, start

    def following(self, leaf: int, k: int) -> Iterator[tuple[int, int, str]]:
        """Places and pre-tokens from there on."""
        while leaf < len(self.leaves):
            pieces = self.leaves[leaf]
            for i in range(k, len(pieces)):
                yield leaf, i, pieces[i]
            leaf, k = leaf + 1, 0

    def edit(self, at: int, length: int, insert: str) -> None:
        at = min(max(at, 0), self.chars[1])
        end = min(at + max(length, 0), self.chars[1])
        leaf, k, start = self.find(max(at - SEEN, 0))
        # Old text from the restart to the place, the inserted text, then old text beyond the edit as far as needed.
        old_end, head, tail = start, [], []
        ends: dict[int, tuple[int, int]] = {}  # new-text offset, from the restart, of old ends beyond the edit: what follows
        shift = len(insert) - (end - at)
        rest = self.following(leaf, k)
        take, done = 8, False
        if at == end == start:
            ends[shift] = (leaf, k)
        while True:
            for _ in range(take):
                got = next(rest, None)
                if got is None:
                    done = True
                    break
                i, j, piece = got
                lo, hi = old_end, old_end + len(piece)
                head.append(piece[:max(0, at - lo)])
                if hi > end:
                    tail.append(piece[max(0, end - lo):])
                old_end = hi
                if hi >= end:
                    ends[hi - start + shift] = (i, j + 1)
            if not done and old_end < end + SEEN + 1:
                take *= 2
                continue
            text = "".join(head) + insert + "".join(tail)
            fresh, size, stop = [], 0, None
            changed = at - start + len(insert)
            for piece in self.split(text):
                if not done and size + len(piece) > len(text) - SEEN:
                    break
                fresh.append(piece)
                size += len(piece)
                if size >= changed and size in ends:
                    stop = ends[size]
                    break
            if stop is None and done:
                stop = (len(self.leaves), 0)
            if stop is not None:
                break
            take *= 2
        counts = self.count(fresh)
        self.reencoded += len(fresh)
        last, after = stop
        kept = self.leaves[leaf][:k]
        if last == leaf:
            lost = self.leaves[leaf][k:after]
            self.put(leaf, kept + fresh + self.leaves[leaf][after:], self.tokens[self.width + leaf] - sum(self.count(lost)) + sum(counts))
            return
        lost = self.leaves[leaf][k:]
        self.put(leaf, kept + fresh, self.tokens[self.width + leaf] - sum(self.count(lost)) + sum(counts))
        for i in range(leaf + 1, min(last, len(self.leaves))):
            self.put(i, [], 0)
        if last < len(self.leaves) and after:
            lost = self.leaves[last][:after]
            self.put(last, self.leaves[last][after:], self.tokens[self.width + last] - sum(self.count(lost)))

    @property
    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the column ``edits`` from rows (doc_id, seq, start, length, insert)."""
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.expr(
        "struct(int(seq) AS seq, bigint(start) AS start, bigint(length) AS length, insert)"))).alias("edits"))
    return docs.drop("edits").join(lists.withColumnRenamed("doc_id", "__id"), F.col(id_col) == F.col("__id"), "left").drop("__id")


def edited_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  edits_col: str = "edits") -> DataFrame:
    """One row per document: its tokens before and after its edits, and how many pre-tokens were encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = []
                cut = enc.counted(part.column(1).to_pylist())
                for doc, (pieces, numbers), edits in zip(part.column(0).to_pylist(), cut, part.column(2).to_pylist(), strict=True):
                    tree = Tree(pieces, enc.count, enc.split, numbers)
                    n = tree.tokens[1]
                    for e in edits or ():
                        tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                    rows.append((doc, n, tree.tokens[1], len(edits or ()), len(pieces), tree.reencoded))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
                       docs[edits_col].cast(EDITS).alias("edits")).mapInArrow(run, SCHEMA)
