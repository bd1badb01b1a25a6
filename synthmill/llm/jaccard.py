"""N-gram Jaccard join: documents whose sets of word shingles overlap by a share or more.

1. Blocks count in how many different sets each shingle is (``blocks``); equal sets of a block count once.
2. A set's shingles are ordered by that number, the rarest first.  Of two similar sets each holds a shared shingle among
   its first n - ceil(t n) + 1, so only these are listed, and of them only shingles that two sets have.
3. Listed sets are laid in blocks of bounded size by the first set they share a list with, by size and by a hash.  Two
   blocks are multiplied if a list touches both and their sizes allow it; equal lists of blocks count once.
4. The product of two blocks of the incidence matrix (documents by shingles) is taken over slices of columns, adding up
   overlaps; a pair is given up as soon as what is left of the smaller rest cannot reach its bound.  Every pair is
   compared in one product at most, and a product returns a spanning forest and counts, never its pairs.
5. Components come from the forests and from equal sets.

Blocks, not pairs, meet where a shingle is common, and a common shingle is listed by those sets only that have hardly a
rarer one.  Overlaps are exact for 64-bit shingle hashes.

A null text counts as empty; a text without words has an empty set and is linked with nothing.  Equal sets are one node,
whatever their keys; rows that repeat a key with other texts are nodes of their own.  Documents without a key link as others
do; their component is null where no key is reachable.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from synthmill.llm.blocks import ASKED, asked, codes, in_blocks, key_array, looked_up, shared_keys, summed, told
from synthmill.llm.common import as_bytes, narrowed, written
from synthmill.llm.components import components

WORDS, PERCENT = 5, 75
#: Sets in a block of the product, and shingles that it should not exceed.
BLOCK_SETS, BLOCK_SHINGLES = 128, 1 << 18
#: Ratio of sizes within a bucket; above the ratio of two similar sets, so these are in the same or the next bucket.
RATIO = 1.4
#: Blocks of a list that are paired with as many others at once.
PAIRED = 256
#: Columns multiplied at once.
COLUMNS = 4096
#: Nodes of sets begin here that no document with a key has, or only documents whose key names another set already.
KEYLESS = 1 << 62

SETS = "doc_id long, text_id binary, n_shingles long, digest string, keys array<long>, shingles array<long>"
LINKS = "node long, other long, links long"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of some texts, sorted and distinct within each, and where each text's begin (and the last end)."""
    split = [raw.lower().split() for raw in raws]
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(w, len(number)) for words in split for w in words], np.int64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))[of] if number else np.zeros(0, np.uint64)
    n = np.fromiter(map(len, split), np.int64, len(split))
    text = np.repeat(np.arange(len(split)), n)
    last = len(word) - WORDS + 1
    if last > 0:
        h = word[:last].copy()
        for k in range(1, WORDS):
            h = h * _MIX + word[k:last + k]
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
        inside = text[:last] == text[WORDS - 1:]
        h, owner = h[inside], text[:last][inside]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < WORDS))
    h = np.r_[h, np.fromiter((xxhash.xxh64_intdigest(b"\0".join(split[i]), seed=WORDS) for i in few), np.uint64, len(few))]
    owner = np.r_[owner, few]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(split) + 1))


class Block:
    """The shingle sets of a block: of each row, and the distinct ones (``first``: their first row by key)."""

    def __init__(self, table: pa.Table):
        self.number = table.column("block")[0].as_py() if table.num_rows else -1
        self.ids = table.column("doc_id").to_pylist()
        h, cuts = shingle_sets(as_bytes(table.column("text").to_pylist()))
        self.n = np.diff(cuts)
        self.digest = [xxhash.xxh3_128_hexdigest(h[a:b].tobytes()) if b > a else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        keys = key_array(self.ids)
        first: dict[str, int] = {}
        for row, digest in enumerate(self.digest):
            if digest and (digest not in first or keys[row] < keys[first[digest]]):
                first[digest] = row
        self.first = np.array(sorted(first.values()), np.int64)
        size = self.n[self.first]
        self.cuts = np.r_[0, np.cumsum(size)]
        at = np.repeat(cuts[self.first] - self.cuts[:-1], size) + np.arange(self.cuts[-1])
        self.shingles, self.owner = h[at], np.repeat(np.arange(len(self.first)), size)


def ask(parts: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        return asked(block.number, *summed(codes(block.shingles, parts), np.ones(len(block.shingles), np.int64)))
    return run


def listed(parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One row per document; the first row of a set that has keys to be listed carries them and the set."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block, (known, totals) = Block(texts), told(answers)
        number = looked_up(codes(block.shingles, parts), known, totals, 1)
        order = np.lexsort((block.shingles, number, block.owner))
        size = np.diff(block.cuts)
        place = np.arange(len(order)) - np.repeat(block.cuts[:-1], size)
        prefix = size - (PERCENT * size + 99) // 100 + 1
        use = (place < prefix[block.owner]) & (number[order] > 1)
        keys, key_owner = block.shingles[order[use]], block.owner[use]
        n_keys = np.bincount(key_owner, minlength=len(size)) if len(size) else np.zeros(0, np.int64)
        keep = (n_keys > 0)[block.owner]
        rows = texts.num_rows
        lengths = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        lengths[0][block.first], lengths[1][block.first] = n_keys, np.where(n_keys > 0, size, 0)
        lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(values.view(np.int64)))
                 for n, values in zip(lengths, (_by_row(keys, n_keys, block.first), _by_row(block.shingles[keep], np.where(n_keys > 0, size, 0), block.first)), strict=True)]
        return pa.table({"doc_id": texts.column("doc_id"), "text_id": texts.column("text_id"), "n_shingles": pa.array(block.n), "digest": pa.array(block.digest, pa.string()),
                         "keys": lists[0], "shingles": lists[1]})
    return run


def _by_row(values: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Runs of values in the order of their rows; sets are numbered by row, so they are in order already."""
    assert (np.diff(rows) > 0).all() and size.sum() == len(values)
    return values


def product(table: pa.Table) -> pa.Table:
    """Rows (block, node, copies, shingles) of one or two blocks to rows of LINKS."""
    sets = table.column("shingles").combine_chunks()
    n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    k = len(n)
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    side = np.unique(table.column("block").to_numpy(), return_inverse=True)[1]
    values, owner = sets.flatten().to_numpy(), np.repeat(np.arange(k), n)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.r_[False, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    total = n[:, None] + n[None, :]
    # 100 * overlap >= PERCENT * (total - overlap), in whole numbers.
    need = -(-PERCENT * total // (100 + PERCENT))
    alive = np.triu(np.ones((k, k), bool), 1) & (node[:, None] != node[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :]))
    if side.max(initial=0) > 0:
        alive &= side[:, None] != side[None, :]  # pairs within a block belong to the block's own product
    overlap = np.zeros((k, k), np.float32)
    rest = np.bincount(owner, minlength=k)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((k, COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        overlap += part @ part.T
        rest = rest - np.bincount(owner[a:b], minlength=k)
        alive &= overlap + np.minimum(rest[:, None], rest[None, :]) >= need
        if not alive.any():
            break
    alive &= overlap >= need
    one, two = np.nonzero(alive)
    links = np.zeros(k, np.int64)
    np.add.at(links, one, copies[two])
    np.add.at(links, two, copies[one])
    root = list(range(k))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(one.tolist(), two.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    linked = np.flatnonzero(links)
    return pa.table({"node": pa.array(node[linked]), "other": pa.array(node[[find(i) for i in linked.tolist()]] if len(linked) else node[:0]),
                     "links": pa.array(links[linked])})


def keyless(digest: str) -> Column:
    return F.lit(KEYLESS) + F.pmod(F.xxhash64(digest), F.lit(KEYLESS >> 1))


def shared_blocks(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of the sets (node, block), and the pairs of blocks (one, two) to be multiplied, from rows (node, n, keys)."""
    entries = written(reps.select("node", "n", F.explode("keys").alias("key")), "entries")
    lists = entries.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("members")).filter("members > 1")
    live = entries.join(lists.select("key", "lead"), "key")
    bucket = F.floor(F.ln(F.col("n").cast("double")) / math.log(RATIO)).cast("int")
    nodes = live.groupBy("node").agg(F.min("lead").alias("lead"), F.max("n").alias("n")).withColumn("bucket", bucket)
    # So many hashed shares for a lead and a size that a block has a bounded number of sets and shingles.
    most = F.greatest(F.lit(2.0), F.least(F.lit(float(BLOCK_SETS)), F.lit(float(BLOCK_SHINGLES)) / F.pow(F.lit(RATIO), F.col("bucket") + 1)))
    shares = nodes.groupBy("lead", "bucket").agg(F.count("*").alias("sets")).withColumn("shares", F.ceil(F.col("sets") / most)).drop("sets")
    placed = nodes.join(shares, ["lead", "bucket"]).withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")))
    placed = written(placed.select("node", F.xxhash64("lead", "bucket", "share").alias("block"), "bucket"), "blocks")
    touched = live.select("key", "node").join(placed, "node").groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("block", "bucket"))).alias("touched")).select("touched").distinct()
    # A long list is paired by parts, each two in a row of their own.
    parts = F.expr(f"cast(ceil(size(touched) / {PAIRED}) AS int)")
    each = touched.withColumn("parts", parts).withColumn("one", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("two", F.explode(F.expr("sequence(one, parts - 1)")))
    each = each.select(*[F.slice("touched", F.col(c) * PAIRED + 1, F.lit(PAIRED)).alias(c) for c in ("one", "two")], (F.col("one") == F.col("two")).alias("same"))
    pairs = each.select(F.explode(F.expr("""flatten(transform(one, (x, i) -> transform(
        filter(two, (y, j) -> (NOT same OR j >= i) AND abs(y.bucket - x.bucket) <= 1), y -> struct(x.block AS one, y.block AS two))))""")).alias("p"))
    pairs = pairs.select("p.one", "p.two").distinct()
    return placed.select("node", "block"), pairs


def linked_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_id, n_shingles, component, component_id, n_links) of each row; ``text_id`` is a digest of the text,
    ``component`` names the component also where it has no key, and is null for a row that is linked with nothing."""
    texts = narrowed(docs, id_col, text_col)
    texts, blocks = in_blocks(texts, "doc_id", "text")
    texts = texts.withColumn("text_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    answers = shared_keys(texts.groupBy("block").applyInArrow(ask(blocks), ASKED))
    rows = written(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(listed(blocks), SETS), "sets")

    # Equal sets are one node, under the smallest key; of sets of one smallest key one has it as its node.
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = classes.withColumn("own", F.coalesce("least", keyless("digest")))
    named = classes.groupBy("own").agg(F.min("digest").alias("named"))
    classes = written(classes.join(named, "own").select("digest", "least", "own", F.when(F.col("digest") == F.col("named"), F.col("own"))
                                                        .otherwise(keyless("digest")).alias("node"), "copies"), "classes")
    # A block has listed its first document of a set; the class's own is that of the smallest key.
    full = rows.filter("size(keys) > 0").withColumn("own", F.coalesce("doc_id", keyless("digest")))
    reps = full.select("digest", "own", F.col("n_shingles").alias("n"), "keys").join(classes.select("digest", "own", "node"), ["digest", "own"])
    placed, pairs = shared_blocks(reps.dropDuplicates(["digest"]).select("node", "n", "keys"))

    units = pairs.withColumn("unit", F.xxhash64("one", "two"))
    units = units.select("unit", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    members = units.join(placed, "block").join(classes.select("node", "own", "copies", "digest"), "node")
    members = members.join(full.select("own", "digest", "shingles").dropDuplicates(["own", "digest"]), ["own", "digest"])
    found = written(members.select("unit", "block", "node", "copies", "shingles").groupBy("unit").applyInArrow(product, LINKS), "links")

    labels = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(labels, "node", "left").join(links, "node", "left").select(
        "digest", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = written(known, "components")
    # A node that is no key can name a component in which there are keys all the same; few do, and the others are not moved for them.
    named = known.filter(F.col("component") < KEYLESS).withColumn("component_id", F.col("component"))
    unnamed = known.filter(F.col("component") >= KEYLESS)
    unnamed = unnamed.join(unnamed.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    known = named.unionByName(unnamed)
    return rows.select("doc_id", "text_id", "n_shingles", "digest").join(known.drop("least"), "digest", "left").drop("digest")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the size of its set, its component, and the number of documents that it links to."""
    alone = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return linked_rows(docs, id_col, text_col).select("doc_id", "n_shingles", alone.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_each(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs`` (doc_id, text and any others): that of the smallest key, of these of the smallest digest of the text.

    Rows that are linked with nothing stay, but for repeats of key and text.  Rows without a key cannot be told apart and stay.
    """
    rows = linked_rows(docs, "doc_id", "text").filter("doc_id IS NOT NULL")
    best = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "text_id")).alias("b")).select("b.*")
    kept = best.unionByName(rows.filter("component IS NULL").select("doc_id", "text_id")).distinct()
    own = "__"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    kept = kept.select(F.col("doc_id").alias(f"{own}key"), F.col("text_id").alias(f"{own}text"))
    known = docs.withColumn(f"{own}id", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    keyed = known.join(kept, (known["doc_id"] == kept[f"{own}key"]) & (known[f"{own}id"] == kept[f"{own}text"]), "left_semi")
    first = F.row_number().over(W.partitionBy("doc_id", f"{own}id").orderBy("doc_id"))
    keyed = keyed.withColumn(f"{own}first", first).filter(F.col(f"{own}first") == 1)
    return keyed.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))
