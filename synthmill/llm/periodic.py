"""Periodic runs of words, by recompression.

1. Texts are sequences of word numbers, each between separators found nowhere else, many texts to a sequence.
2. Recompression: in turns, blocks of one symbol become a symbol (symbol and length, the run-length rules), and pairs become
   a symbol where the left one is of one half of the alphabet and the right one of the other.  Symbols are numbered by what
   they stand for, so equal symbols are equal words; levels shrink geometrically, and where a level joins symbols depends on
   neighbours only.
3. The longest common extension of two places, to either side, climbs the levels while the symbols agree and both places are
   at a border of the next level, and comes down again where they differ: some steps a level, for many pairs of places at once.
4. Candidates of period q are the places of a grid of 3 q (a harmonic sum over all q) that have their own word again q words
   on, and four in a row along q.  Their extensions to both sides give the run exactly.  Multiples of a period give the same
   ends, of which the smallest period stays.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words that cannot be extended; runs of one text
may overlap.  ``collapsed`` leaves out the words that a run holds beyond its first q.

A null text counts as empty; an empty text has no runs and collapses to nothing; texts of any length are taken whole; rows
that repeat a key are judged one by one; columns other than key and text are left out.  The work is per row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from synthmill.llm.common import as_bytes, narrowed, slices

#: Words of the shortest run, and periods that a run must hold.
LEAST, TIMES = 6, 4
#: Pairs of places whose extensions are computed at once.
QUERIES_AT_ONCE = 1 << 17

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Level:
    """A sequence of the grammar: symbols, and where the next sequence has borders (``up``: its place there, else -1)."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        self.up = self.first = self.ahead = self.behind = None

    def joined(self, starts: np.ndarray) -> None:
        """``starts``: the places at which symbols of the next level begin."""
        self.first = starts.astype(np.int32)
        self.up = np.full(len(self.symbols), -1, np.int32)
        self.up[starts] = np.arange(len(starts), dtype=np.int32)


def numbered(*parts: np.ndarray) -> np.ndarray:
    """A number for each different row of ``parts``."""
    order = np.lexsort(parts)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for p in parts:
        q = p[order]
        new[1:] |= q[1:] != q[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


class Grammar:
    """Levels of a sequence whose ``separators`` (its first and last symbol among them) are different from all else."""

    def __init__(self, symbols: np.ndarray, separators: int):
        """Symbols below ``separators`` are separators, each of them once."""
        self.levels: list[Level] = []
        self.next = int(symbols.max(initial=0)) + 1
        self.separators = separators
        current = symbols.astype(np.int32)
        turn = 0
        while len(current) > 2 * separators - 1:  # else each text is one symbol
            blocks = np.flatnonzero(current[1:] == current[:-1])
            if len(blocks):
                current = self.blocks(current)
            if len(current) > 2 * separators - 1:
                current = self.pairs(current, turn)
            turn += 1
        self.levels.append(Level(current))

    def blocks(self, s: np.ndarray) -> np.ndarray:
        """Each block of one symbol becomes a symbol."""
        level = Level(s)
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[starts, len(s)])
        level.joined(starts)
        place = np.arange(len(s)) - np.repeat(starts, size)
        level.ahead, level.behind = (np.repeat(size, size) - place).astype(np.int32), (place + 1).astype(np.int32)
        self.levels.append(level)
        out = s[starts].copy()
        long = np.flatnonzero(size > 1)
        out[long] = self.next + numbered(out[long], size[long])
        self.next = max(self.next, int(out.max()) + 1)
        return out

    def pairs(self, s: np.ndarray, turn: int) -> np.ndarray:
        """Each pair of a left and a right symbol becomes a symbol."""
        h = (s.astype(np.uint64) + np.uint64(2 * turn + 1)) * _MIX
        left = ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(63)).astype(bool)
        text = s >= self.separators
        inside = text[:-1] & text[1:]
        one, two = np.flatnonzero(left[:-1] & ~left[1:] & inside), np.flatnonzero(~left[:-1] & left[1:] & inside)
        at = one if len(one) >= len(two) else two  # the half that joins more is the left one
        if not len(at):
            return s
        level = Level(s)
        begins = np.ones(len(s), bool)
        begins[at + 1] = False
        starts = np.flatnonzero(begins)
        level.joined(starts)
        self.levels.append(level)
        out = s[starts].copy()
        out[level.up[at]] = self.next + numbered(s[at], s[at + 1])
        self.next = max(self.next, int(out.max()) + 1)
        return out

    def extensions(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """How many symbols are equal from each two places on (``back``: before them)."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        side = -1 if back else 0
        top = np.full(len(a), len(self.levels) - 1)
        live = np.arange(len(a))

        def step(level: Level, rows: np.ndarray) -> np.ndarray:
            """Moves the rows whose next symbols agree; these rows."""
            x, y = a[rows] + side, b[rows] + side
            same = level.symbols[x] == level.symbols[y]
            rows, x, y = rows[same], x[same], y[same]
            run = level.behind if back else level.ahead
            by = 1 if run is None else np.minimum(run[x], run[y])
            a[rows] += -by if back else by
            b[rows] += -by if back else by
            return rows

        for k, level in enumerate(self.levels[:-1]):
            rows = live
            stuck = np.zeros(0, np.int64)
            while len(rows):
                rows = rows[(level.up[a[rows]] < 0) | (level.up[b[rows]] < 0)]
                moved = step(level, rows)
                if len(moved) < len(rows):
                    stuck = np.r_[stuck, np.setdiff1d(rows, moved, assume_unique=True)]
                rows = moved
            if len(stuck):
                top[stuck] = k
                live = np.setdiff1d(live, stuck, assume_unique=True)
            a[live], b[live] = level.up[a[live]], level.up[b[live]]
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            rows = here = np.flatnonzero(top >= k)
            while len(rows):
                rows = step(level, rows)
            if k:
                first = self.levels[k - 1].first
                a[here], b[here] = first[a[here]], first[b[here]]
        return i - a if back else a - i


def candidates(s: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the grids that may lie in a run; texts have ``longest`` symbols at most."""
    at: list[np.ndarray] = []
    period: list[np.ndarray] = []
    for q in range(1, longest // TIMES + 1):
        grid = TIMES * q - q
        one = s[:-q:grid]
        hit = np.flatnonzero(one == s[q::grid][:len(one)]) * grid
        if len(hit):
            at.append(hit)
            period.append(np.full(len(hit), q))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, q = np.concatenate(at), np.concatenate(period)
    # A run of TIMES periods has so many equal words along q, the place and the next one among them.
    n = len(s)

    def equal(k: int) -> np.ndarray:
        x, y = i + k * q, i + (k + 1) * q
        ok = (x >= 0) & (y < n)
        return ok & (s[np.where(ok, x, 0)] == s[np.where(ok, y, 0)])

    steps = {k: equal(k) for k in range(2 - TIMES, TIMES - 1)}
    keep = np.zeros(len(i), bool)
    for k in range(2 - TIMES, 1):
        keep |= np.logical_and.reduce([steps[k + m] for m in range(TIMES - 1)])
    return i[keep], q[keep]


def runs_of(s: np.ndarray, separators: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of all runs of a sequence, by start and period."""
    i, q = candidates(s, longest)
    none = np.zeros(0, np.int64)
    if not len(i):
        return none, none, none
    grammar = Grammar(s, separators)
    found = []
    for at in range(0, len(i), QUERIES_AT_ONCE):
        x, p = i[at:at + QUERIES_AT_ONCE], q[at:at + QUERIES_AT_ONCE]
        start = x - grammar.extensions(x, x + p, True)
        end = x + p + grammar.extensions(x, x + p, False)
        ok = end - start >= np.maximum(LEAST, TIMES * p)
        found.append(np.unique(np.stack((start[ok], end[ok], p[ok])), axis=1))
    start, end, p = np.unique(np.concatenate(found, axis=1), axis=1)
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, bool)
    start, end, p = start[first], end[first], p[first]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def searched(texts: list[str | None]) -> tuple[list[int], list[list[dict]], list[str]]:
    """Words, runs and collapsed text of each of some texts."""
    split = [raw.split() for raw in as_bytes(texts)]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    separators = len(split) + 1
    number: dict[bytes, int] = {}
    s = np.empty(int(sizes.sum()) + separators, np.int32)
    s[0], at = 0, 1
    begins = np.empty(len(split), np.int64)
    for k, words in enumerate(split):
        begins[k], end = at, at + len(words)
        s[at:end] = [number.setdefault(w, len(number)) for w in words]
        s[at:end] += separators
        s[end] = k + 1
        at = end + 1
    start, end, period = runs_of(s, separators, int(sizes.max(initial=0)))
    dropped = np.zeros(len(s) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, end, -1)
    stays = np.cumsum(dropped) == 0
    cuts = np.searchsorted(start, np.r_[begins, len(s)])
    runs, left = [], []
    for k, words in enumerate(split):
        a, b, base = cuts[k], cuts[k + 1], begins[k]
        runs.append([{"start": x, "length": y, "period": z} for x, y, z in
                     zip((start[a:b] - base).tolist(), (end[a:b] - start[a:b]).tolist(), period[a:b].tolist(), strict=True)])
        if a < b:
            words = [words[w] for w in np.flatnonzero(stays[base:base + len(words)]).tolist()]
        left.append(b" ".join(words).decode())
    return sizes.tolist(), runs, left


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in slices(batch):
            n, runs, left = searched(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()),
                                              "runs": pa.array(runs, pa.list_(_RUN)), "collapsed": pa.array(left, pa.string())})


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, its runs by start and period, and its text without the repetitions."""
    return narrowed(docs, id_col, text_col).mapInArrow(search, SCHEMA)
