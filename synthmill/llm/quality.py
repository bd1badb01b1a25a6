"""Quality rules by suffix-array repetition.

A text is a sequence of words (maximal runs of anything but ASCII white space).  A suffix array over the words of each
document, made by prefix doubling, gives the longest common prefix of neighbouring suffixes.  Every interval of that
array is a maximal repeated word sequence; the union of the spans of all its occurrences is the covered part of the text.
A document goes if the covered fraction or the longest repeat is over its limit, or if a base rule fails.

Many documents share one array: the first sort key of a suffix is its document, so suffixes of two documents never meet.
A null text counts as empty, an empty text has no words and fails the base rules, repeated rows are judged one by one,
columns other than the key and the text are left out.  The work is per row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from synthmill.llm.common import as_bytes, narrowed, slices
from synthmill.session import small_batches

#: Words of the window that the base rule counts.
BASE_WINDOW = 3
#: Shortest repeat, in words, that counts for the covered fraction.
MIN_REPEAT = 8
#: Limits in percent of the document's words.
MAX_COVERED = 50
MAX_LONGEST = 40
MIN_WORDS = 50
MAX_REPEAT_WORDS = 50

#: Characters of text that are judged at once: their words and arrays take some forty times that.
AT_ONCE = 512 << 10

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, covered_words long, longest_repeat long")


def suffix_ranks(symbols: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes after 1, 2, 4, ... symbols, until all differ.

    Two ranks of level l are equal just if the documents and the next 2**l symbols are.  ``symbols`` ends each document
    with a separator found nowhere else in it, so no comparison runs past an end.
    """
    n = len(symbols)
    order = np.lexsort((symbols, doc))
    s, d = symbols[order], doc[order]
    head = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])]) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    size = np.diff(np.r_[head, n])
    rank[order] = np.repeat(head, size)
    active = np.sort(order[np.repeat(size > 1, size)])
    levels, step = [rank], 1
    while len(active):
        rank = rank.copy()
        old = levels[-1]
        key = old[active] * (n + 1) + old[active + step]
        by = np.argsort(key, kind="stable")
        at, key = active[by], key[by]
        group = old[at]
        place = np.arange(len(at))
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sub = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[sub, len(at)])
        begin = np.repeat(first, np.diff(np.r_[first, len(at)]))
        rank[at] = group + np.repeat(sub, sizes) - begin[place]
        active = np.sort(at[np.repeat(sizes > 1, sizes)])
        levels.append(rank)
        step *= 2
    return levels


def neighbour_prefixes(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and, for each place but the first, the common prefix with the suffix before it."""
    last = levels[-1]
    array = np.empty(len(last), np.int64)
    array[last] = np.arange(len(last))
    lcp = np.zeros(max(len(last) - 1, 0), np.int64)
    same = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) if len(last) else np.zeros(0, np.int64)
    a, b = array[same], array[same + 1]
    length = np.zeros(len(same), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        equal = levels[level][a] == levels[level][b]
        jump = equal * (1 << level)
        a, b, length = a + jump, b + jump, length + jump
    lcp[same] = length
    return array, lcp


def repeat_lengths(symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the longest sequence from there that starts elsewhere in the same document too."""
    array, lcp = neighbour_prefixes(suffix_ranks(symbols, doc))
    best = np.zeros(len(symbols), np.int64)
    if len(symbols):
        best[array] = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
    return best


def covered(length: np.ndarray) -> np.ndarray:
    """Whether each position lies in one of the spans [i, i + length[i])."""
    change = np.zeros(len(length) + 1, np.int64)
    starts = np.flatnonzero(length)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length[starts], -1)
    return np.cumsum(change[:-1]) > 0


def judged(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The figures and verdicts of some texts."""
    raw = as_bytes(texts)
    split = [b.split() for b in raw]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    number: dict[bytes, int] = {}
    symbols = np.empty(int(n_words.sum()) + len(split), np.int64)
    at = 0
    for words in split:
        end = at + len(words)
        symbols[at:end] = [number.setdefault(w, len(number)) for w in words]
        symbols[end] = -1
        at = end + 1
    doc = np.repeat(np.arange(len(split)), n_words + 1)
    best = repeat_lengths(symbols, doc)
    ends = np.cumsum(n_words + 1)
    starts = ends - n_words - 1
    total = lambda flags: np.add.reduceat(flags.astype(np.int64), starts) if len(split) else np.zeros(0, np.int64)
    repeat = total(covered(np.where(best >= BASE_WINDOW, BASE_WINDOW, 0)))
    spans = total(covered(np.where(best >= MIN_REPEAT, best, 0)))
    longest = np.maximum.reduceat(best, starts) if len(split) else np.zeros(0, np.int64)
    count = lambda f: np.fromiter((f(i) for i in range(len(raw))), np.int64, len(raw))

    def repeated_lines(i: int) -> int:
        lines = [x for x in raw[i].split(b"\n") if x.strip(SPACES)]
        return len(lines) - len(set(lines))

    base_failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_WORDS * n_words)
    fine = (100 * spans <= MAX_COVERED * n_words) & (100 * longest <= MAX_LONGEST * n_words)
    return {
        "n_words": n_words,
        "word_chars": count(lambda i: len(texts[i] or "") - len(raw[i]) + len(raw[i].translate(None, SPACES))),
        "n_symbols": count(lambda i: len(raw[i]) - len(raw[i].translate(None, SYMBOLS))),
        "n_dup_lines": count(repeated_lines), "n_repeat_words": repeat, "base_failed": base_failed,
        "kept": ~base_failed & fine, "covered_words": spans, "longest_repeat": longest,
    }


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in slices(batch, AT_ONCE):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), **judged(texts)})


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, the base rule, the repeats found and the verdict ``kept``."""
    return narrowed(docs, id_col, text_col).mapInArrow(judge, SCHEMA)


def kept(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at)], ["doc_id", "text"])
            verdicts = [judged(t)["kept"] for _, t in slices(texts, AT_ONCE)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *verdicts])))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
