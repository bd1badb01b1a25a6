"""Records of delimited text with line breaks inside quotes, read by as many tasks as the file has blocks.

Whether a line starts inside a quoted cell depends on everything before it.  So each block is read under both
assumptions, which soon agree where there are quotes.  What it does to either is one row of a small table; a running
composition of those rows tells how each block really starts and where the record began that reaches into it.  Records
within a block, after that agreement, leave it whole; the lines of the others meet by their record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from synthmill.functions.lineage import kept

_CELLS = r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+,)*+'
_OPEN = rf'{_CELLS}"[^"]*+(?:""[^"]*+)*+\Z'
#: Lines that end inside a quoted cell, if they start a record, and if they start inside a quoted cell.
OPENS = re.compile(rf"(?!#){_OPEN}")
STAYS = re.compile(rf'[^"]*+(?:""[^"]*+)*+(?:\Z|"[^,]*+,{_OPEN})')
#: A quoted cell, or the blanks at the end of another.
BLANKS = r'((?:^|,)"[^"]*+(?:""[^"]*+)*+"?)|[\x00-\x20]++(?=,|\z)'

# Lines of a block that need other blocks, ``n`` numbers them.  Of each pair, the first holds if the block starts outside
# quotes, the second if inside: whether the line starts and ends inside, and the line (or -1) its record starts at.
# The first record with content is among them, because it may be a header; a last row without text tells how the block ends.
LINES = ("path string, block long, n long, line string, from_out boolean, from_in boolean,"
         " to_out boolean, to_in boolean, start_out long, start_in long")
RECORDS = "path string, record string"
_COMMA, _QUOTE, _RETURN, _HASH = b',"\r#'
_LOOK = 1024


class _Quoted:
    """The lines of a batch that hold quotes.

    A line is plain, from outside or from inside quotes, if each of its quotes opens after a comma, closes before one or is
    one of two; then it turns the state if their number is odd.  Other lines (and comments) are left to the patterns.
    """

    def __init__(self, line: pa.Array) -> None:
        line = line.cast(pa.large_string())
        ends = np.frombuffer(line.buffers()[1], np.int64)[line.offset:line.offset + len(line) + 1]
        data = np.frombuffer(line.buffers()[2] or b"", np.uint8)
        at = np.flatnonzero(data[ends[0]:ends[-1]] == _QUOTE) + ends[0]
        owner = np.searchsorted(ends, at, "right") - 1
        self.text = line
        self.lines, first, count = np.unique(owner, return_index=True, return_counts=True)
        self.odd = count % 2 == 1
        if not len(at):
            self.rough_out = self.rough_in = self.odd
            return
        low, high = ends[owner], ends[owner + 1]
        before, after = data[np.maximum(at - 1, 0)], data[np.minimum(at + 1, len(data) - 1)]
        opens = (at == low) | (before == _COMMA) | (before == _QUOTE)
        closes = (at + 1 == high) | (after == _COMMA) | (after == _QUOTE) | ((after == _RETURN) & (at + 2 == high))
        even = (np.arange(len(at)) - np.repeat(first, count)) % 2 == 0
        self.rough_out = np.logical_or.reduceat(~np.where(even, opens, closes), first) | (data[ends[self.lines]] == _HASH)
        self.rough_in = np.logical_or.reduceat(~np.where(even, closes, opens), first)

    def __len__(self) -> int:
        return len(self.lines)

    def step(self, i: int, inside: bool) -> bool:
        """Whether the ``i``-th of these lines ends inside quotes."""
        if not (self.rough_in if inside else self.rough_out)[i]:
            return bool(inside ^ self.odd[i])
        return (STAYS if inside else OPENS).match(self.text[int(self.lines[i])].as_py()) is not None

    def states(self, i: int, inside: bool) -> np.ndarray:
        """The state before the ``i``-th line and after it and each later one."""
        out = [np.array([inside])]
        while i < len(self):
            odd = self.odd[i:i + _LOOK]
            after = inside ^ (np.cumsum(odd) % 2 == 1)
            rough = np.where(after ^ odd, self.rough_in[i:i + _LOOK], self.rough_out[i:i + _LOOK])
            plain = int(np.argmax(rough)) if rough.any() else len(odd)
            out.append(after[:plain])
            inside = bool(after[plain - 1]) if plain else inside
            i += plain
            if plain < len(odd):
                inside = self.step(i, inside)
                out.append(np.array([inside]))
                i += 1
        return np.concatenate(out)


def _joined(lines: list[pa.Array], ends: np.ndarray) -> pa.Array:
    """The lines up to each of ``ends`` as one text each."""
    offsets = pa.array(np.concatenate([[0], ends + 1]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pa.concat_arrays(lines)), "\n")


class _Block:
    """The state of one block between batches: under both assumptions until both are outside quotes, then the one state.

    The first block of a file starts outside.  ``take`` and ``rest`` yield whole records as arrays, other lines as the
    columns ``n`` to ``start_in``.
    """

    def __init__(self, first: bool) -> None:
        self.lines, self.inside, self.start, self.settled, self.headed = 0, [False, not first], [-1, -1], first, False
        self.open: list[pa.Array] = []

    def take(self, line: pa.Array) -> Iterator[list | pa.Array]:
        quoted, done, used = _Quoted(line), 0, 0
        if not self.settled:
            ways = [[self.inside[0]], [self.inside[1]]]
            while used < len(quoted) and not self.settled:
                for states in ways:
                    states.append(quoted.step(used, states[-1]))
                self.settled = not (ways[0][-1] or ways[1][-1])
                used += 1
            done = int(quoted.lines[used - 1]) + 1 if self.settled else len(line)
            yield self._both(line.slice(0, done), quoted.lines[:used], ways)
        if done < len(line):
            yield from self._one(line.slice(done), quoted.lines[used:] - done, quoted.states(used, self.inside[0]))

    def _both(self, line: pa.Array, quoted: np.ndarray, ways: list[list[bool]]) -> list:
        n = np.arange(self.lines, self.lines + len(line))
        before, after = (np.searchsorted(quoted, np.arange(len(line)), side) for side in ("left", "right"))
        came = [np.array(states)[before] for states in ways]
        starts = [np.maximum.accumulate(np.where(c, s, n)) for c, s in zip(came, self.start)]
        self.lines += len(line)
        self.inside = [states[-1] for states in ways]
        self.start = [int(s[-1]) for s in starts]
        return [n, line, *came, *(np.array(states)[after] for states in ways), *starts]

    def _one(self, line: pa.Array, quoted: np.ndarray, states: np.ndarray) -> Iterator[list | pa.Array]:
        ends = np.flatnonzero(~states[np.searchsorted(quoted, np.arange(len(line)), "right")])
        self.inside = [bool(states[-1])] * 2
        if len(ends):
            came = sum(map(len, self.open))
            records = _joined([*self.open, line], ends + came)
            self.open = []
            if not self.headed:
                head = next((i for i, r in enumerate(records) if r.as_py() not in ("", "\r") and not r.as_py().startswith("#")), None)
                if head is not None:
                    self.headed = True
                    n = np.array([self.lines - came if head == 0 else self.lines + ends[head - 1] + 1])
                    no = np.zeros(1, bool)
                    yield [n, records.slice(head, 1), no, no, no, no, n, n]
                    yield records.slice(0, head)
                    records = records.slice(head + 1)
            yield records
            line, self.lines = line.slice(int(ends[-1]) + 1), self.lines + int(ends[-1]) + 1
            came = 0
        if len(line):
            self.open.append(line)
            self.lines += len(line)

    def rest(self) -> Iterator[list]:
        """The lines of the record that is open at the block's end, and how the block ends."""
        if self.open:
            line = pa.concat_arrays(self.open)
            n = np.arange(self.lines - len(line), self.lines)
            start, to = np.full(len(n), n[0]), np.ones(len(n), bool)
            yield [n, line, n > n[0], n > n[0], to, to, start, start]
        ends = [np.array([i]) for i in self.inside]
        yield [np.array([self.lines]), pa.nulls(1, pa.string()), *ends, *ends, *(np.array([-1]) for _ in ends)]


def _framed(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Whole records, or the other lines."""
    names = [part.split()[0] for part in (RECORDS if whole else LINES).split(", ")]

    def rows(key: tuple, told: Iterator[list | pa.Array]) -> Iterator[pa.RecordBatch]:
        for columns in told:
            if isinstance(columns, list) != whole:
                arrays = [columns] if whole else [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns]
                keys = [pa.repeat(k, len(arrays[0])) for k in (key[:1] if whole else key)]
                yield pa.RecordBatch.from_arrays([*keys, *arrays], names)

    here, block = None, None
    for batch in batches:
        path, start, line = (batch.column(i) for i in range(3))
        changed = np.ones(batch.num_rows, bool)
        changed[1:] = (pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False)
                       | pc.not_equal(start[1:], start[:-1]).to_numpy(zero_copy_only=False))
        bounds = [*np.flatnonzero(changed).tolist(), batch.num_rows]
        for low, high in zip(bounds, bounds[1:]):
            key = (path[low].as_py(), start[low].as_py())
            if key != here:
                if block:
                    yield from rows(here, block.rest())
                here, block = key, _Block(key[1] == 0)
            yield from rows(key, block.take(line.slice(low, high - low)))
    if block:
        yield from rows(here, block.rest())


def block_starts(lines: DataFrame) -> DataFrame:
    """How each block starts: (path, block, inside, came_block, came_start, header).

    ``came_…`` is the start of the record that reaches into the block, ``header`` the line of the file's first record
    where it lies in the block.
    """
    bit = F.col("n") * 4 + F.col("to_out").cast("long") * 2 + F.col("to_in").cast("long")
    content = ~F.col("line").isin("", "\r") & ~F.startswith("line", F.lit("#"))
    blocks = lines.groupBy("path", "block").agg(
        F.max(bit).alias("last"), F.max("start_out").alias("start_out"), F.max("start_in").alias("start_in"),
        F.min(F.when(content, F.col("n"))).alias("head"))
    # A block ends as it starts, the other way, or always in one way.  Since the last of those, only turns count.
    order = W.partitionBy("path").orderBy("block")
    out, into = F.col("last").bitwiseAND(2) > 0, F.col("last").bitwiseAND(1) > 0
    turns = F.sum(F.when(out & ~into, 1).otherwise(0)).over(order)
    turned = blocks.withColumn("turns", turns).withColumn("fixed", F.when(out == into, F.pmod(out.cast("int") - F.col("turns"), F.lit(2))))
    ends = F.pmod(F.coalesce(F.last("fixed", ignorenulls=True).over(order), F.lit(0)) + F.col("turns"), F.lit(2)) == 1
    ended = turned.withColumn("ends", ends).withColumn("inside", F.coalesce(F.lag("ends").over(order), F.lit(False)))
    start = F.when(F.col("inside"), F.col("start_in")).otherwise(F.col("start_out"))
    came = F.last(F.when(start >= 0, F.struct("block", start.alias("start"))), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, -1))
    first = F.min(F.when(F.col("head").isNotNull(), F.col("block"))).over(W.partitionBy("path"))
    return ended.withColumn("came", came).select(
        "path", "block", "inside", F.col("came.block").alias("came_block"), F.col("came.start").alias("came_start"),
        F.when(F.col("block") == first, F.col("head")).alias("header"))


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files as (record, partition columns of the folder), without each file's header, comments, blank lines and blanks behind cells.

    Lines end in ``\\n`` or ``\\r\\n``; a cell opens its quotes with its first character and writes a quote inside as two.
    A quote that is never closed makes the rest of its file, but for its last line break, one record.  A record is one row.
    The lines that need other blocks are written when this is called: those before the first quotes of a block, and its last record.
    """
    text = spark.read.text(path, lineSep="\n")
    folders = text.columns[1:]
    raw = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = kept(raw.mapInArrow(partial(_framed, whole=False), LINES), "lines")
    known = lines.where("line IS NOT NULL").join(block_starts(lines), ["path", "block"])

    def really(name: str) -> Column:
        return F.when(F.col("inside"), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))

    own = really("start") >= 0
    known = known.select(
        "path", "block", "n", "line", (really("from") | really("to")).alias("shared"),
        F.coalesce(F.col("n") == F.col("header"), F.lit(False)).alias("headed"),
        F.when(own, F.col("block")).otherwise(F.col("came_block")).alias("at_block"),
        F.when(own, really("start")).otherwise(F.col("came_start")).alias("at"))
    alone = known.where("NOT shared AND NOT headed").select("path", F.col("line").alias("record"))
    met = known.where("shared").groupBy("path", "at_block", "at").agg(
        F.sort_array(F.collect_list(F.struct("block", "n", "line"))).alias("parts"), F.bool_or("headed").alias("headed"))
    records = (raw.mapInArrow(partial(_framed, whole=True), RECORDS).unionByName(alone)
               .unionByName(met.where("NOT headed").select("path", F.array_join("parts.line", "\n").alias("record"))))
    record = F.regexp_replace(F.replace("record", F.lit("\r\n"), F.lit("\n")), BLANKS, "$1")
    records = records.select("path", record.alias("record")).where((F.col("record") != "") & ~F.startswith("record", F.lit("#")))
    if not folders:
        return records.select("record")
    named = text.select(F.col("_metadata.file_path").alias("path"), *folders).distinct()
    return records.join(named, "path").select("record", *folders)


def has_quotes(spark: SparkSession, path: str) -> bool:
    return not spark.read.text(path, lineSep="\n").where(F.contains("value", F.lit('"'))).isEmpty()


def larger_than_a_block(spark: SparkSession, path: str) -> bool:
    """Whether a file below ``path`` is cut into several blocks by Spark."""
    block = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    return (largest or 0) > block
