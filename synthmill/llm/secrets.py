"""Secret scans in DataFrame functions only.

Base kinds are patterns.  Beyond them, candidate strings (long unbroken runs of key characters with letters and digits)
are scanned by a sliding window: each step takes one character out of the window's counts and one in, and changes the
running sum of c * log2(c) by the difference, so the window's Shannon entropy costs no recount.  Each character class has
its own limit.  Candidates that are as a whole on the allow list (paths, UUIDs, placeholders, alphabets) add nothing; base spans stay.

Spans are code points, end exclusive.  A null text counts as empty; an empty text has no spans; repeated rows are scanned
one by one; other columns are left out by ``scan`` and kept by ``masked``, whatever their names.  The work is per row, and linear in
the text: lists grow in runs of bounded length.  Nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Base kinds in the order in which ties are listed: (kind, pattern, group that has a least length, that length).
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16)]
METHOD = "entropy"

#: Candidate strings of the entropy scan, its window, and the least entropy in bits by character class.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: A value of letters and digits behind a name or prefix is judged as it would be alone.
CLASSES = [("hex", "^[0-9A-Fa-f]+$", 3.0), ("alphanumeric", "^[A-Za-z0-9]+$", 3.7),
           ("named hex", "[=_](?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{20,}$", 3.0),
           ("named alphanumeric", "[=_](?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{20,}$", 3.7), ("base64", ".", 3.8)]
def _start_of(letters: str, least: int) -> str:
    """Pattern of the first letters of an alphabet, at least so many."""
    tail = ""
    for c in reversed(letters[least:]):
        tail = f"(?:{c}{tail})?"
    return letters[:least] + tail


#: Candidates that are no secrets: no letter or no digit, UUIDs, paths; words with a placeholder among them and a short
#: number; starts of alphabets, runs of one character and separators.  All describe the whole candidate: a word or a run
#: inside a longer string says nothing of the rest.  Groups that repeat are possessive: Java walks the others by recursion.
ALLOWED = ["^[^0-9]*$", "^[^A-Za-z]*$", "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "^[a-z]+(?:/[a-z0-9_-]+)++/?$",
           "(?i)^(?=.*(?:example|placeholder|changeme|your[_-]))(?:[a-z]{1,12}[=_-]+)*+(?:[a-z]{1,12})?[0-9]{0,6}$",
           f"(?i)^(?:{_start_of('abcdefghijklmnopqrstuvwxyz', 8)}|{_start_of('0123456789', 8)}|(.)\\1{{5,}}+|[+/_=-])++$"]

LIST = "array<struct<start:int,kind:int,end:int>>"
_SCALE = 1 << 20
#: c * log2(c) in units of 2**-20 bits, for c up to the window.
PLOGP = [0] + [round(c * math.log2(c) * _SCALE) for c in range(1, WINDOW + 1)]
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counts of a window, five bits each, so many in a whole number.
_BITS, _PACKED = 5, 12
_FIELDS = len(_ALPHABET) // _PACKED + 1
#: Windows of a candidate that one pass covers, elements of a list that are summed up at once, code points of a piece of text.
#: They bound what is copied when a list grows; results do not depend on them.
CHUNK, RUN, PIECE = 256, 256, 1024


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``value``, computed once, under a name.

    What a lambda uses is a variable, not a column: Spark may put a column's expression into the lambda, for each element.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def _div(a: str, b: int) -> str:
    return f"cast(({a}) div {b} AS int)"


def running(df: DataFrame, lists: dict[str, str], op: str) -> DataFrame:
    """``df`` with columns of running sums (``op`` "+") or maxima ("greatest") of int lists: within runs, then over the runs."""
    one = lambda a, b: f"{a} + {b}" if op == "+" else f"greatest({a}, {b})"
    none = "cast(array() AS array<int>)"
    runs = f"""CASE WHEN size(v) > 0 THEN transform(sequence(0, {_div('size(v) - 1', RUN)}), j ->
        aggregate(slice(v, j * {RUN} + 1, {RUN}), {none}, (a, x) -> concat(a, array({one("if(size(a) = 0, 0, element_at(a, -1))", "x")})))) END"""
    df = df.withColumns({f"{name}_in": F.expr(_let(sql, "v", runs)) for name, sql in lists.items()})
    before = f"aggregate(r, array(0), (a, p) -> concat(a, array({one('element_at(a, -1)', 'element_at(p, -1)')})))"
    whole = f"flatten(zip_with(r, slice({before}, 1, size(r)), (p, o) -> transform(p, x -> {one('x', 'o')})))"
    return df.withColumns({name: F.expr(f"coalesce({_let(f'{name}_in', 'r', f'if(r IS NULL, NULL, {whole})')}, {none})") for name in lists})


def _window(codes: str, base: str) -> str:
    """SQL of the spans (s, e) of a run of windows over a list of character codes, from ``base`` on."""
    f = f"array({','.join(f'{x}L' for x in PLOGP)})"
    count = lambda n, code: f"cast(shiftright({n}[{_div(code, _PACKED)}], {_BITS} * ({code} % {_PACKED})) & 31 AS int)"
    moved = lambda code: f"if(k = {_div(code, _PACKED)}, shiftleft(1L, {_BITS} * ({code} % {_PACKED})), 0L)"
    start = f"({base} + x.i - {WINDOW})"
    gone, come = "y.gone", "y.come"
    after = f"a.sum + if({gone} > 0, {f}[{gone} - 1] - {f}[{gone}], 0L) + {f}[{come} + 1] - {f}[{come}]"
    spans = f"""CASE WHEN x.i < {WINDOW} OR z.sum > a.most THEN a.spans
        WHEN size(a.spans) > 0 AND element_at(a.spans, -1).e >= {start} THEN
          concat(slice(a.spans, 1, size(a.spans) - 1), array(named_struct('s', element_at(a.spans, -1).s, 'e', {start} + {WINDOW})))
        ELSE concat(a.spans, array(named_struct('s', {start}, 'e', {start} + {WINDOW}))) END"""
    counted = f"named_struct('gone', if(x.out > 0, {count('a.n', 'x.out')}, 0), 'come', {count('a.n', 'x.into')} - if(x.into = x.out, 1, 0))"
    summed = f"named_struct('sum', {after})"
    new = f"""named_struct('n', transform(a.n, (v, k) -> v + {moved('x.into')} - if(x.out > 0, {moved('x.out')}, 0L)),
        'sum', z.sum, 'most', a.most, 'spans', {spans})"""
    return f"""aggregate(transform({codes}, (c, i) -> named_struct('i', i + 1, 'into', c, 'out', if(i >= {WINDOW}, {codes}[i - {WINDOW}], 0))),
        named_struct('n', array_repeat(0L, {_FIELDS}), 'sum', 0L, 'most', most, 'spans', cast(array() AS array<struct<s:int,e:int>>)),
        (a, x) -> {_let(counted, 'y', _let(summed, 'z', new))},
        a -> a.spans)"""


def entropy_spans(candidate: str, start: str) -> str:
    """SQL of the spans of one candidate: unions of windows whose entropy reaches the limit of the candidate's class."""
    # Entropy H of a window: log2(W) - sum(c log2 c) / W, so H >= limit is sum <= W * (log2(W) - limit).
    most = lambda limit: math.floor(WINDOW * (math.log2(WINDOW) - limit) * _SCALE)
    limit = "CASE " + " ".join(f"WHEN {candidate} RLIKE '{p}' THEN {most(e)}L" for _, p, e in CLASSES) + " END"
    allowed = " OR ".join(f"{candidate} RLIKE '{p}'" for p in ALLOWED).replace("\\", "\\\\")
    codes = f"transform(filter(split({candidate}, ''), c -> c <> ''), c -> instr('{_ALPHABET}', c))"
    run = _let(f"slice(codes, j * {CHUNK} + 1, {CHUNK + WINDOW - 1})", "part", _window("part", f"j * {CHUNK}"))
    runs = f"flatten(transform(sequence(0, {_div(f'size(codes) - {WINDOW}', CHUNK)}), j -> {run}))"
    # Spans of neighbouring runs that meet are one: their first starts and their last ends.
    first = "transform(filter(found, (x, i) -> i = 0 OR found[i - 1].e < x.s), x -> x.s)"
    last = "transform(filter(found, (x, i) -> i = size(found) - 1 OR found[i + 1].s > x.e), x -> x.e)"
    spans = f"zip_with({first}, {last}, (s, e) -> named_struct('start', cast({start} + s AS int), 'kind', {len(KINDS)}, 'end', cast({start} + e AS int)))"
    return f"""CASE WHEN {allowed} THEN cast(array() AS {LIST}) ELSE {_let(codes, "codes", _let(limit, "most", _let(runs, "found", spans)))} END"""


def spanned(docs: DataFrame, text_col: str, own: str) -> DataFrame:
    """``docs`` with columns whose names begin with ``own``: the text, and the base spans and all spans as arrays of
    (start, kind number, end) in the order of start and kind."""
    named = [*KINDS, (METHOD, CANDIDATE, 0, WINDOW)]
    every = range(len(named))
    df = docs.withColumn(f"{own}text", F.coalesce(docs[text_col].cast("string"), F.lit("")))
    df = df.withColumns({f"{own}m{i}": F.regexp_extract_all(f"{own}text", F.lit(p), F.lit(0)) for i, (_, p, _, _) in enumerate(named)})
    # The other passes over a text are made only where there is a match.
    df = df.withColumns({f"{own}g{i}": F.when(F.size(f"{own}m{i}") > 0, F.split(f"{own}text", p, -1)) for i, (_, p, _, _) in enumerate(named)}
                        | {f"{own}k{i}": F.when(F.size(f"{own}m{i}") > 0, F.regexp_extract_all(f"{own}text", F.lit(p), F.lit(g))) if g else F.col(f"{own}m{i}")
                           for i, (_, p, g, _) in enumerate(named)})
    # Where a match ends is the length of all up to it: the strings between matches, and the matches.
    df = df.withColumns({f"{own}n{i}": F.expr(f"zip_with(slice({own}g{i}, 1, size({own}m{i})), {own}m{i}, (g, m) -> char_length(g) + char_length(m))") for i in every})
    df = running(df, {f"{own}e{i}": f"{own}n{i}" for i in every}, "+")
    df = df.withColumns({f"{own}s{i}": F.expr(f"""coalesce(filter(transform(arrays_zip({own}m{i}, {own}k{i}, {own}e{i}), c -> if(char_length(c.{own}k{i}) < {least}, NULL,
        named_struct('start', c.{own}e{i} - char_length(c.{own}m{i}), 'kind', {i}, 'end', c.{own}e{i}))), x -> x IS NOT NULL), cast(array() AS {LIST}))""") for i, (_, _, _, least) in enumerate(named)})
    last = len(KINDS)
    more = F.expr(f"flatten(transform(arrays_zip({own}s{last}, {own}m{last}), c -> {entropy_spans(f'c.{own}m{last}', f'c.{own}s{last}.start')}))")
    df = df.withColumns({f"{own}base": F.array_sort(F.concat(*[f"{own}s{i}" for i in range(last)])), f"{own}more": more})
    return df.withColumn(f"{own}all", F.array_sort(F.concat(f"{own}base", f"{own}more")))


def _unused(docs: DataFrame) -> str:
    """A beginning that no column's name has."""
    own = "__"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    return own


def joined(spans: str) -> Column:
    names = ",".join(f"'{k}'" for k in [*(k for k, *_ in KINDS), METHOD])
    return F.expr(f"concat_ws(',', transform({spans}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)))")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    df = spanned(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "text", "__")
    counts = [F.expr(f"cast(size(filter(__base, x -> x.kind = {i})) AS long)").alias(f"n_{k}") for i, (k, *_) in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(joined("__base").cast("binary"), 256).alias("base_sha256"), joined("__all").alias("spans"),
                     F.size("__more").cast("long").alias("n_entropy"))


def masked(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of the text (overlapping ones together) replaced by ``mask``; null texts stay null."""
    own = _unused(docs)
    df = spanned(docs, text_col, own)
    text, spans = f"{own}text", f"{own}all"
    df = running(df, {f"{own}high": f"transform({spans}, x -> x.end)"}, "greatest")
    # A mask begins where a span begins beyond all before it, and ends where all before the next one end.
    begins = "transform(filter(v, (x, i) -> i = 0 OR h[i - 1] <= x.start), x -> x.start)"
    ends = "filter(h, (x, i) -> i = size(v) - 1 OR v[i + 1].start >= x)"
    bounds = f"named_struct('from', concat(array(0), {ends}), 'to', concat({begins}, array(char_length({text}))))"
    df = df.withColumns({f"{own}gaps": F.expr(_let(spans, "v", _let(f"{own}high", "h", bounds))),
                         f"{own}pieces": F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))})
    # What stays, between the masks: pieces of the text as a whole, or their ends and beginnings.
    first, last = _div("f", PIECE), _div("t", PIECE)
    inner = f"array_join(slice(p, {first} + 2, greatest({last} - {first} - 1, 0)), '')"
    stays = f"""CASE WHEN f >= t THEN '' WHEN {first} = {last} THEN substr(p[{first}], f % {PIECE} + 1, t - f)
        ELSE concat(substr(p[{first}], f % {PIECE} + 1), {inner}, coalesce(substr(get(p, {last}), 1, t % {PIECE}), '')) END"""
    cut = F.array_join(F.expr(_let(f"{own}pieces", "p", f"zip_with({own}gaps.from, {own}gaps.to, (f, t) -> {stays})")), mask)
    return df.withColumn(text_col, F.when(F.size(spans) > 0, cut).otherwise(df[text_col])).select(*docs.columns)
