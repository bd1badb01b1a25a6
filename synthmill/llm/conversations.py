"""Repair of the structure of conversations, by grammar-compressed dynamic programming.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Each row is kept (0), given the role user or assistant (2) or
deleted (3); rows of that role without text may be inserted anywhere (2).  Blank rows and duplicates (role and text seen
earlier) must be deleted; a truncated row that stays adds 1.  Of the cheapest edits those with the ASCII-least initials count.

1. Rows that are equal in all but their number are counted, so copies move once; the first of a role and text is no duplicate.
   Only a digest of the text takes part.
2. Each conversation becomes a string of symbols (role initial and fault), read off a sorted stream.
3. Re-Pair makes rules of pairs of symbols that the strings of many conversations share, the most frequent first.
4. Each rule has one min-plus matrix: the cost from each state of the role automaton to each other, and the initials of the
   cheapest edits as a rope whose halves are those of the rule's parts.  It is evaluated once, bottom-up, and used by all
   conversations of a task; what is left of a conversation is folded from the start state.
5. The edits meet the texts in a second sorted stream, so that no conversation is gathered as rows: a task holds a byte or two
   for each row of a conversation, and hashes (or hands on) its texts one after the other.

Rows are taken by turn, nulls first; rows of one turn by role, then by the digest of role and text.  Nulls in role and text
count as one space.  Rows without a conversation are one conversation.  Roles that begin with none of s, u, a can only be
changed or deleted.  An empty table gives no rows.  Columns other than the four are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from synthmill.llm.common import rows_of

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Costs of the edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Symbols: a row that must go, or an initial (of INITIALS, else the last) and whether it is truncated.
INITIALS = "sua"
GONE, OTHER = 0, len(INITIALS)
FAULTS = ("blank", "duplicate", "truncated")
#: States of the role automaton: nothing yet, after the system's, after the user's and after the assistant's row.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
ENDING = (START, AFTER_A)
NAMES = {"u": "user", "a": "assistant"}

#: Symbols of the conversations that share a grammar, and most rules that a task remembers between them.
SHARE, REMEMBERED = 1 << 16, 1 << 15

Rope = str | tuple  # a string, or (length, rope, rope)
Entry = tuple[int, Rope]
Matrix = dict[tuple[int, int], Entry]


def symbol(initial: str, truncated: bool) -> int:
    at = INITIALS.find(initial) if initial else -1
    return 1 + 2 * (at if at >= 0 else OTHER) + truncated


SYMBOLS = symbol("", True) + 1


def joined(a: Rope, b: Rope) -> Rope:
    if not a or not b:
        return a or b
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= 32:
        return a + b
    return (size(a) + size(b), a, b)


def size(rope: Rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[0]


def leaves(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += [top[2], top[1]]


def flat(rope: Rope) -> str:
    return "".join(leaves(rope))


def less(a: Rope, b: Rope) -> bool:
    """Whether one rope is before the other, read leaf by leaf up to where they differ."""
    one, two = leaves(a), leaves(b)
    x = y = ""
    while True:
        x, y = x or next(one, ""), y or next(two, "")
        if not x or not y:
            return not x and bool(y)
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x < y
        x, y = x[n:], y[n:]


def offer(matrix: Matrix, ends: tuple[int, int], cost: int, rope: Rope) -> None:
    """Keeps the cheaper entry, of equal ones the first in ASCII.

    Of two equally dear edits of the same rows none is the beginning of the other (further inserts cost more), so that the
    choice stays right whatever follows.
    """
    old = matrix.get(ends)
    if old is None or cost < old[0] or cost == old[0] and less(rope, old[1]):
        matrix[ends] = (cost, rope)


def inserted() -> Matrix:
    """Rows inserted: from each state to all that they reach, by one round of the automaton at most."""
    out: Matrix = {}
    for state in NEXT:
        at, cost, rope = state, 0, ""
        offer(out, (state, at), cost, rope)
        for _ in range(3):
            at = NEXT[at]["a" if at == AFTER_U else "u"]
            cost, rope = cost + INSERT, rope + "I"
            offer(out, (state, at), cost, rope)
    return out


def product(one: Matrix, two: Matrix) -> Matrix:
    """Min-plus product."""
    out: Matrix = {}
    for (x, y), (cost, rope) in one.items():
        for z in NEXT:
            more = two.get((y, z))
            if more is not None and ((x, z) not in out or cost + more[0] <= out[x, z][0]):
                offer(out, (x, z), cost + more[0], joined(rope, more[1]))
    return out


def edited(sym: int) -> Matrix:
    """A row after any inserted ones."""
    out: Matrix = {}
    for state in NEXT:
        offer(out, (state, state), DELETE, "D")
        if sym == GONE:
            continue
        initial, truncated = divmod(sym - 1, 2)
        if initial < OTHER and INITIALS[initial] in NEXT[state]:
            offer(out, (state, NEXT[state][INITIALS[initial]]), TRUNCATED * truncated, "K")
        to = "a" if state == AFTER_U else "u"
        offer(out, (state, NEXT[state][to]), REROLE + TRUNCATED * truncated, "R")
    return product(INSERTED, out)


INSERTED = inserted()
TERMINALS = [edited(s) for s in range(SYMBOLS)]


class Rules:
    """Rules of pairs and their matrices, shared by the conversations of a task."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple[int, int], int] = {}
        self.matrices = list(TERMINALS)

    def rule(self, left: int, right: int) -> int:
        found = self.number.get((left, right))
        if found is None:
            found = self.number[left, right] = len(self.matrices)
            self.matrices.append(product(self.matrices[left], self.matrices[right]))
        return found

    def repaired(self, strings: list[bytes]) -> list[tuple[int, str]]:
        """Cost and initials of the edits of each of some strings of symbols."""
        if len(self.matrices) > REMEMBERED:
            self.clear()
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        s = np.full(int(sizes.sum()) + len(strings), -1, np.int64)
        s[np.arange(len(s) - len(strings)) + np.repeat(np.arange(len(strings)), sizes)] = np.frombuffer(b"".join(strings), np.uint8)
        s = self.compressed(s)
        out, state = [], {START: (0, "")}
        for sym in s.tolist():
            if sym >= 0:
                state = {z: e for (_, z), e in product({(START, y): e for y, e in state.items()}, self.matrices[sym]).items()}
                continue
            ends = product({(START, y): e for y, e in state.items()}, INSERTED)
            best: Matrix = {}
            for end in ENDING:
                if (START, end) in ends:
                    offer(best, (0, 0), *ends[START, end])
            out.append((best[0, 0][0], flat(best[0, 0][1])))
            state = {START: (0, "")}
        return out

    def compressed(self, s: np.ndarray) -> np.ndarray:
        """Re-Pair: the most frequent pairs become rules, together with others that share no symbol with them, while any repeats."""
        while True:
            pairs = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
            wide = len(self.matrices)
            code, count = np.unique(s[pairs] * wide + s[pairs + 1], return_counts=True)
            order = np.argsort(-count, kind="stable")
            chosen: dict[int, int] = {}
            used: set[int] = set()
            for k in order[count[order] > 1].tolist():
                left, right = divmod(int(code[k]), wide)
                if left in used or right in used:
                    continue
                used |= {left, right}
                chosen[int(code[k])] = self.rule(left, right)
            if not chosen:
                return s
            known = np.array(sorted(chosen))
            names = np.array([chosen[c] for c in known.tolist()])
            here = s[pairs] * wide + s[pairs + 1]
            at = np.minimum(np.searchsorted(known, here), len(known) - 1)
            hit = known[at] == here
            place, name = pairs[hit], names[at[hit]]
            # Pairs of one symbol overlap in a block of it: there every other one counts.
            first = np.r_[True, np.diff(place) > 1]
            run = np.flatnonzero(first)
            odd = (np.arange(len(place)) - np.repeat(run, np.diff(np.r_[run, len(place)]))) % 2 == 1
            place, name = place[~odd], name[~odd]
            s = s.copy()
            s[place] = name
            stays = np.ones(len(s), bool)
            stays[place + 1] = False
            s = s[stays]


# --- rows and faults, as columns

def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns under fixed names, with ``times``: how often a row is there (0: a row of which only the conversation counts)."""
    return df.select(df[conv].cast("long").alias("conv_id"), df[turn].cast("long").alias("turn"), df[role].cast("string").alias("role"),
                     df[text].cast("string").alias("text"), F.lit(1).alias("times"))


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` without nulls in role and text, with a digest of both."""
    rows = rows.withColumns({"role": text_of("role"), "text": text_of("text")})
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, ending, later, times): rows without texts; ``ending`` is 0 (blank), 1 (truncated) or 2 (whole)."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    ending = F.when(end == "", 0).when(F.substring(end, -1, 1).isin(*ENDS), 2).otherwise(1)
    rows = rows.withColumn("ending", ending)
    once = rows.groupBy("conv_id", "turn", "role", "digest", "ending").agg(F.sum(F.col("times").cast("long")).alias("times"))
    earlier = W.partitionBy("conv_id", "digest", F.col("times") > 0).orderBy(F.asc_nulls_first("turn"))
    return once.withColumn("later", F.row_number().over(earlier) > 1)


# --- the two streams

REPORT = [("conv_id", "long"), ("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long")]
EDITS = ", ".join(f"{k} {v}" for k, v in [*REPORT, ("cost", "long"), ("audit", "string")])
_KINDS = [*[pa.int64()] * (len(REPORT) + 1), pa.string()]


class Reading:
    """What is known of a conversation while its rows pass in order."""

    def __init__(self, conv: int | None):
        self.conv, self.symbols = conv, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def add(self, turn: int | None, initial: str, ending: int, later: bool, times: int) -> None:
        if not times:
            return
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += times - 1  # the same initial again
        self.last = initial
        spare = times if later or ending == 0 else times - 1
        if ending == 0:
            self.blank += times
        else:
            self.duplicate += spare
        if spare < times:
            self.truncated += ending == 1
            self.symbols.append(symbol(initial, ending == 1))
        self.symbols += bytes([GONE]) * spare

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal


def edit_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, initial, ending, later, times) to rows of EDITS, some conversations at a time."""
    rules, ready, symbols = Rules(), [], 0
    now: Reading | None = None

    def out(some: list[Reading]) -> pa.RecordBatch:
        strings = list(dict.fromkeys(bytes(c.symbols) for c in some))
        found = dict(zip(strings, rules.repaired(strings), strict=True))
        rows = [(*c.row(), *found[bytes(c.symbols)]) for c in some]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)],
                                          [f.split()[0] for f in EDITS.split(", ")])

    for batch in batches:
        for conv, *row in rows_of(batch, 4096):
            if now is None or conv != now.conv:
                if now is not None:
                    ready.append(now)
                    symbols += len(now.symbols) + 16
                if symbols >= SHARE:
                    yield out(ready)
                    ready, symbols = [], 0
                now = Reading(conv)
            now.add(*row)
    if now is not None:
        yield out([*ready, now])


def edits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (keyed): its figures, and the cheapest edits."""
    small = faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    return small.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "ending", "later", "times").mapInArrow(edit_streams, EDITS)


def applied(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each row that stays or is new."""
    state = START
    for edit in audit:
        role, text = "", ""
        if edit != "I":
            role, text = next(rows)
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else "a" if state == AFTER_U else "u"
        state = NEXT[state][initial]
        yield edit, role if edit == "K" else NAMES[initial], text


def met(rows: DataFrame) -> DataFrame:
    """Edits and texts in one sorted stream: of each conversation first its edits, then its rows in order."""
    found = edits(rows)
    names = [n for n, _ in REPORT] + ["cost", "audit"]
    heads = found.select(*names, F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in
                                                            (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "binary"), ("times", "long"))])
    tails = rows.filter("times > 0").select("conv_id", *[F.lit(None).cast(t).alias(n) for n, t in [*REPORT[1:], ("cost", "long"), ("audit", "string")]],
                                            F.lit(1).alias("kind"), "turn", "role", "text", "digest", F.col("times").cast("long").alias("times"))
    both = heads.unionByName(tails).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest").drop("turn", "digest")


def by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """The head of each conversation, and its rows one after the other; these must be read to the end before the next head."""
    stream = (row for batch in batches for row in rows_of(batch))
    waiting: list[tuple] = []
    width = len(REPORT) + 2

    def texts() -> Iterator[tuple[str, str]]:
        for row in stream:
            if row[width] == 0:
                waiting.append(row)
                return
            for _ in range(row[-1]):
                yield row[-3], row[-2]

    for first in stream:
        waiting.append(first)
        while waiting:
            yield waiting.pop()[:width], texts()


def repaired_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: (conv_id, place from 0, edit K, R or I, role, text)."""
    return rows_repaired(keyed(conversations(df, conv, turn, role, text)))


def rows_repaired(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "place", "edit", "role", "text"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        out: list[tuple] = []
        weight = 0
        for head, texts in by_conversation(batches):
            for place, (edit, who, said) in enumerate(applied(head[-1], texts)):
                out.append((head[0], place, edit, who, said))
                weight += len(said) + 64
                if weight > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, weight = [], 0
            for _ in texts:
                pass
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return met(rows).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def rows_reported(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (keyed, with their number): figures, edits, and the hash of the repaired ``role:text`` lines."""
    names = [n for n, _ in REPORT] + ["cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for head, texts in by_conversation(batches):
            digest, line = hashlib.sha256(), ""
            for _, who, said in applied(head[-1], texts):
                digest.update(f"{line}{who}:{said}".encode())
                line = "\n"
            for _ in texts:
                pass
            out.append((*head, digest.hexdigest()))
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [*_KINDS, pa.string()], strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [*_KINDS, pa.string()], strict=True)], names)

    return met(rows).mapInArrow(run, f"{EDITS}, repaired_sha256 string")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: faults found, cheapest edits and their cost, and the hash of what they make of it."""
    return rows_reported(keyed(conversations(df, conv, turn, role, text)))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with faults planted by the checksum of conversation and turn; a dropped row keeps its conversation."""
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text_of("text"), ENDS, "")).otherwise(text_of("text"))
    return rows.withColumns({"role": F.when(kind == 4, "user").otherwise(text_of("role")), "text": text,
                             "times": F.when(kind == 0, 0).when(kind == 3, 2).otherwise(F.lit(1))})
