"""SimHash near-duplicates by a self-join of a binary trie.

1. Fingerprints: a bit is 1 if it is set in over half the XXH64 hashes of a text's word shingles, repeats included.
2. Documents of one fingerprint are one class; only distinct fingerprints go on.
3. Two fingerprints that differ in 3 bits or fewer differ in at most one bit of one of their halves.  So there are two tries,
   each with another half on top: a pair of nodes may differ in ``HALF_BITS`` while they are in the top half and in
   ``MOST_BITS`` all in all.  Node pairs are walked from the root; the differing bits of a pair are those of its two
   prefixes, each counted once, and a pair is pruned as soon as they exceed the budget of its depth.
4. The upper nodes are walked as tables, some bits a round, until the fingerprints below a pair are few enough for a task;
   dense parts of the trie are cut deeper.  No fingerprint comes to the driver, and a node of any size is split.
5. A task walks the rest of its pair, a level at a time over the sorted fingerprints, and returns a spanning forest and
   counts of links.  Components come from the forests.

A null or empty text, or one without words, has fingerprint zero and is linked like any other.  Rows that repeat a key or
have none each keep their row; a component in which no row has a key has a null id.  Columns other than key and text are
left out, so clashing names do no harm.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from synthmill.llm.common import as_bytes, narrowed, slices, written
from synthmill.llm.components import components

WORDS, SEED = 3, 42
MOST_BITS, HALF_BITS = 3, 1
#: Bits of the trie that a round of tables goes down, and fingerprints below a pair that a task takes.
STEP, UNIT = 4, 1 << 16
#: Node pairs that a task expands at once, and products of sizes that are compared outright.
FRONTIER, SMALL = 1 << 15, 32

PRINTS = "doc_id long, print long"
LINKS = "node long, other long, links long"


def hashes(raw: bytes, words: int = WORDS) -> np.ndarray:
    """The hashes of the shingles of one text, in order."""
    split = raw.lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    text = b" ".join(split)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], np.uint64)
    size = np.fromiter(map(len, split), np.int64, len(split)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[:len(split) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist(), strict=True)), np.uint64, len(starts))


def prints(texts: list[str | None], words: int = WORDS) -> np.ndarray:
    """The fingerprints of some texts."""
    out = np.zeros(len(texts), np.uint64)
    for i, raw in enumerate(as_bytes(texts)):
        found = hashes(raw, words)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(found), 1 << 16):
            ones += np.unpackbits(found[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0]
    return out


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, print): the fingerprint of each row, as the long of the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "print": prints(texts, words).view(np.int64)})

    return narrowed(docs, id_col, text_col).mapInArrow(run, PRINTS)


def turned(bits: Column) -> Column:
    """The halves of a fingerprint changed over; twice is the fingerprint again."""
    return F.shiftleft(bits, 32).bitwiseOR(F.shiftrightunsigned(bits, 32))


def prefix(key: Column, depth: int) -> Column:
    """The first bits of a key; a whole key has no node number of its own but is its own."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key, 64 - depth)


def pairs_of_nodes(keys: DataFrame, unit: int = UNIT) -> DataFrame:
    """(unit, trie, depth, a, b, differ): pairs of nodes of the tries of ``keys`` (trie, key), with no more than ``unit`` keys below."""
    root = keys.groupBy("trie").agg(F.count("*").alias("size"))
    zero = F.lit(0).cast("long")
    level = root.select("trie", zero.alias("a"), zero.alias("b"), F.lit(0).alias("differ"), F.col("size").alias("below"))
    closed: list[DataFrame] = []
    for depth in range(0, 65, STEP):
        level = written(level, "trie-level")
        enough = F.lit(depth == 64) | (F.col("below") <= unit)  # whole keys are not split, however small the unit
        closed.append(level.filter(enough).select("trie", F.lit(depth).alias("depth"), "a", "b", "differ"))
        wide = level.filter(~enough)
        if wide.isEmpty():
            break
        below = keys.groupBy("trie", prefix(F.col("key"), depth + STEP).alias("child")).agg(F.count("*").alias("size"))
        below = below.withColumn("parent", F.shiftrightunsigned("child", STEP))
        one = below.select("trie", F.col("parent").alias("a"), F.col("child").alias("one"), F.col("size").alias("n_one"))
        two = below.select("trie", F.col("parent").alias("b"), F.col("child").alias("two"), F.col("size").alias("n_two"))
        met = wide.join(one, ["trie", "a"]).join(two, ["trie", "b"]).filter((F.col("a") < F.col("b")) | (F.col("one") <= F.col("two")))
        met = met.withColumn("differ", F.bit_count(F.col("one").bitwiseXOR(F.col("two"))))  # of the whole prefixes
        met = met.filter(F.col("differ") <= (HALF_BITS if depth + STEP <= 32 else MOST_BITS))
        level = met.select("trie", F.col("one").alias("a"), F.col("two").alias("b"), "differ",
                           F.when(F.col("one") == F.col("two"), F.col("n_one")).otherwise(F.col("n_one") + F.col("n_two")).alias("below"))
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.withColumn("unit", F.xxhash64("trie", "depth", "a", "b"))


def compared(table: pa.Table) -> pa.Table:
    """The links of one pair of nodes: rows (unit, trie, depth, key, copies) to rows of LINKS."""
    key = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key, kind="stable")
    v, copies = key[order], table.column("copies").to_numpy()[order].astype(np.float64)
    trie, depth = table.column("trie")[0].as_py(), table.column("depth")[0].as_py()
    n, shift = len(v), np.uint64(64 - depth)
    cut = n
    if depth:
        cut = int(np.searchsorted(v >> shift, v[-1] >> shift)) if depth < 64 else int(np.searchsorted(v, v[-1]))
    a, b = ((0, n), (0, n)) if cut in (0, n) else ((0, cut), (cut, n))
    differ = 0 if a == b else int(np.bitwise_count((v[0] ^ v[-1]) >> shift))
    label, links = np.arange(n), np.zeros(n)

    def met(i: np.ndarray, j: np.ndarray) -> None:
        bits = v[i] ^ v[j]
        top = np.bitwise_count(bits >> np.uint64(32))
        ok = (top <= HALF_BITS) & (np.bitwise_count(bits) <= MOST_BITS)
        if trie:  # the other trie has the pairs that hardly differ in its own top half
            ok &= np.bitwise_count(bits << np.uint64(32)) > HALF_BITS
        i, j = i[ok], j[ok]
        if not len(i):
            return
        links[:] += np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        while True:
            x, y = label[i], label[j]
            if (x == y).all():
                return
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label[:] = label[label]

    stack = [(depth, np.array([[a[0]], [a[1]], [b[0]], [b[1]], [differ]]))]
    while stack:
        depth, front = stack.pop()
        if front.shape[1] > FRONTIER:
            stack += [(depth, front[:, FRONTIER:])]
            front = front[:, :FRONTIER]
        na, nb = front[1] - front[0], front[3] - front[2]
        few = na * nb <= SMALL if depth < 64 else np.ones(len(na), bool)
        if few.any():
            lo, wide, size, start = front[0][few], nb[few], (na * nb)[few], front[2][few]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = np.repeat(lo, size) + place // np.repeat(wide, size), np.repeat(start, size) + place % np.repeat(wide, size)
            met(i[i < j], j[i < j])
            front = front[:, ~few]
        if not front.shape[1]:
            continue
        alo, ahi, blo, bhi, differ = front
        bit = np.uint64(1) << np.uint64(63 - depth)
        above = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
        amid = np.clip(np.searchsorted(v, (v[alo] & above) | bit), alo, ahi)
        bmid = np.clip(np.searchsorted(v, (v[blo] & above) | bit), blo, bhi)
        apart = alo != blo
        down = [np.stack(x) for x in ((alo, amid, blo, bmid, differ), (amid, ahi, bmid, bhi, differ), (alo, amid, bmid, bhi, differ + 1))]
        down.append(np.stack((amid, ahi, blo, bmid, differ + 1))[:, apart])
        down = np.concatenate(down, axis=1)
        budget = HALF_BITS if depth < 32 else MOST_BITS
        down = down[:, (down[1] > down[0]) & (down[3] > down[2]) & (down[4] <= budget)]
        if down.shape[1]:
            stack.append((depth + 1, down))
    linked = np.flatnonzero(links)
    back = v.view(np.int64) if not trie else ((v << np.uint64(32)) | (v >> np.uint64(32))).view(np.int64)
    return pa.table({"node": back[linked], "other": back[label[linked]], "links": links[linked].astype(np.int64)})


def near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, unit: int = UNIT) -> DataFrame:
    """One row per document: fingerprint, component, and the number of other documents that it links to."""
    rows = written(fingerprinted(docs, id_col, text_col, words), "prints")
    classes = written(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "print-classes")
    print_ = F.col("print")
    keys = classes.select(F.explode(F.array(F.struct(F.lit(0).alias("trie"), print_.alias("key")), F.struct(F.lit(1).alias("trie"), turned(print_).alias("key")))).alias("k"),
                          "copies").select("k.trie", "k.key", "copies")
    units = written(pairs_of_nodes(keys.select("trie", "key"), unit), "trie-pairs")
    depths = [r.depth for r in units.select("depth").distinct().orderBy("depth").collect()]  # 17 at most
    nodes = units.select("unit", "trie", "depth", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
    placed = [keys.withColumns({"depth": F.lit(d), "node": prefix(F.col("key"), d)}).join(nodes, ["trie", "depth", "node"]) for d in depths]
    found = None
    for members in placed:
        part = members.select("unit", "trie", "depth", "key", "copies")
        found = part if found is None else found.unionByName(part)
    if found is None:  # an empty table
        links = written(keys.select(F.col("key").alias("node"), F.col("key").alias("other"), F.col("copies").alias("links")), "print-links")
    else:
        links = written(found.groupBy("unit").applyInArrow(compared, LINKS), "print-links")

    labels = components(links.select(F.col("node").alias("u"), F.col("other").alias("v")))
    own = classes.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    counts = links.groupBy(F.col("node").alias("print")).agg(F.sum("links").alias("links"))
    known = own.join(least, "component").join(counts, "print", "left").select(
        "print", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    return rows.join(known, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", "n_links")
