"""Periodic runs, conversation repair and SimHash, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from synthmill.llm import conversations as talk, periodic, simhash
from synthmill.llm.queries import QUERIES
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = "doc_id long, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
in_order = lambda rows: sorted((tuple(r) for r in rows), key=str)


def extra(spark, rows):
    """A frame with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 7, 1.5) for r in rows], f"{EMPTY}, print string, runs int, component double").repartition(3)


# --- periodic runs

def runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng):
    words = [rng.choice("abcdefghijklmnopqrstuvwxyz"[:rng.choice([1, 2, 3, 5, 26])]) for _ in range(rng.choice([0, 1, 5, 20, 60, 200]))]
    for _ in range(rng.randint(0, 4)):
        if words:
            at, p = rng.randrange(len(words)), rng.randint(1, 6)
            words[at:at] = (words[at:at + p] * 40)[:rng.randint(1, 40)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(0)
    for _ in range(25):
        texts = [some_words(rng) for _ in range(rng.randint(1, 40))]
        n, found, left = periodic.searched([" ".join(t) for t in texts])
        for words, size, got, rest in zip(texts, n, found, left, strict=True):
            want = runs(words)
            assert size == len(words) and [(r["start"], r["length"], r["period"]) for r in got] == want and rest == collapsed(words, want)


def test_extensions_are_those_of_the_sequence():
    rng = random.Random(4)
    s = np.array([0, *[rng.choice([2, 2, 3, 4]) for _ in range(400)], 1])
    grammar = periodic.Grammar(s, 2)
    i = np.array([rng.randint(1, 400) for _ in range(500)])
    j = np.array([rng.randint(1, 400) for _ in range(500)])
    i, j = i[i != j], j[i != j]
    forward, back = grammar.extensions(i, j, False), grammar.extensions(i, j, True)
    for x, y, f, b in zip(i, j, forward, back, strict=True):
        k = 0
        while s[x + k] == s[y + k]:
            k += 1
        assert k == f
        k = 0
        while s[x - 1 - k] == s[y - 1 - k]:
            k += 1
        assert k == b


def test_very_long_runs():
    for text, want in (("a " * 200_000, [(0, 200_000, 1)]), ("x " + "a b c " * 100_000, [(1, 300_000, 3)]), (" ".join(map(str, range(100_000))), [])):
        _, [got], [left] = periodic.searched([text])
        assert [(r["start"], r["length"], r["period"]) for r in got] == want
    text = " ".join(f"w{i % 9_000}" for i in range(50_000))
    _, [got], [left] = periodic.searched([text])
    assert got == [{"start": 0, "length": 50_000, "period": 9_000}] and left.count(" ") == 8_999


def test_periodic_takes_nulls_and_clashing_columns(spark):
    rows = [(None, None), (1, ""), (1, "a " * 8), (2, " \t\n"), (2, " \t\n")]
    got = in_order(periodic.periodic(extra(spark, rows)).select("doc_id", "n_words", "collapsed").collect())
    assert got == in_order([(None, 0, ""), (1, 0, ""), (1, 8, "a"), (2, 0, ""), (2, 0, "")])
    assert periodic.periodic(spark.createDataFrame([], EMPTY)).collect() == []


def test_periodic_query_equals_brute_force(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = runs(words)
        s, length, q = max(found, key=lambda x: (x[1], -x[0], -x[2])) if found else (None, None, None)
        want.append((r.doc_id, len(found), s, length, q, 1000 * length // q if found else None,
                     sha("".join("%d,%d,%d\n" % x for x in found)), sha(collapsed(words, found)), n))
    assert in_order(QUERIES["op11_periodic_runs"](spark, SF).collect()) == in_order(want)


# --- conversations

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows):
    """Cost and initials of the edits of (initial, fault), by dynamic programming over whole strings from the end."""
    never = (10 ** 9, "")
    after = None
    for i in range(len(rows), -1, -1):
        here = []
        for state in range(4):
            if i == len(rows):
                here.append((0, "") if state in (0, 3) else never)
                continue
            initial, fault = rows[i]
            options = [(3 + after[state][0], "D" + after[state][1])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if initial in NEXT[state]:
                    c, a = after[NEXT[state][initial]]
                    options.append((more + c, "K" + a))
                c, a = after[NEXT[state]["a" if state == 2 else "u"]]
                options.append((2 + more + c, "R" + a))
            here.append(min(options))
        for _ in range(5):
            for state in range(4):
                c, a = here[NEXT[state]["a" if state == 2 else "u"]]
                here[state] = min(here[state], (2 + c, "I" + a))
        after = here
    return after[0]


def diagnosed(data, damage):
    """What the query returns for (conv_id, turn, role, text), row by row."""
    found = collections.defaultdict(list)
    for conv, turn, role, text in data:
        text_of = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20 if damage else 99
        role, text = text_of(role), text_of(text)
        found[conv] += [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in rows:
            letters = WORD.findall(text)
            faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1][-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = cheapest([(r[1][:1], f) for r, f in zip(rows, faults, strict=True)])
        state, left, out = 0, iter(rows), []
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (0, "", "")
            if edit != "D":
                initial = role[:1] if edit == "K" else "a" if state == 2 else "u"
                state = NEXT[state][initial]
                out.append((role if edit == "K" else {"u": "user", "a": "assistant"}[initial], text))
        yield conv, gaps, *(faults.count(f) for f in talk.FAULTS), illegal, cost, audit, out


def with_hash(found):
    return in_order((*row[:-1], sha("\n".join(f"{r}:{t}" for r, t in row[-1]))) for row in found)


def talks(seed):
    rng = random.Random(seed)
    for conv in range(300):
        for t in range(rng.choice([1, 2, 3, 5, 9, 30])):
            yield (None if conv == 5 else conv, rng.choice([t, t, t, None, rng.randint(-3, 40)]), rng.choice(["user", "assistant", "system", "tool", None, "", "User"]),
                   rng.choice(["Hi.", "a", "b.", "c?", "", None, " \t", "x! ", "more lines\n" * 3, "é.", "Hi."]))
    for t in range(2500):
        yield 7777, t, rng.choice(["user", "assistant"]), f"text {t}{rng.choice(['.', ''])}"


def test_repairs_equal_brute_force(spark):
    data = list(talks(3))
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "conv_id long, turn long, role string, text string, times int, audit string").repartition(5)
    want = list(diagnosed(data, damage=False))
    assert in_order(talk.repair(df).collect()) == with_hash(want)
    rows = collections.defaultdict(list)
    for r in talk.repaired_rows(df).orderBy("place").collect():
        rows[r.conv_id].append((r.role, r.text))
    assert all(rows[w[0]] == w[-1] for w in want)
    damaged = talk.rows_reported(talk.keyed(talk.damaged(talk.conversations(df))))
    assert in_order(damaged.collect()) == with_hash(diagnosed(data, damage=True))


def test_repair_query_equals_brute_force(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert in_order(QUERIES["op12_conversation_repair"](spark, SF).collect()) == with_hash(diagnosed(data, damage=True))


def test_matrices_of_rules_are_those_of_their_rows(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(talk, "REMEMBERED", 200)
    rules = talk.Rules()
    for _ in range(20):
        strings = [bytes(rng.choices(range(talk.SYMBOLS), [3, 1, 1, 6, 3, 6, 3, 1, 1], k=rng.choice([0, 1, 4, 40, 200]))) for _ in range(30)]
        for string, got in zip(strings, rules.repaired(strings), strict=True):
            rows = [("", "blank") if s == talk.GONE else ((talk.INITIALS + "x")[(s - 1) // 2], "truncated" if (s - 1) % 2 else "") for s in string]
            assert got == cheapest(rows)


def test_conversations_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(talk, "SHARE", 10)
    data = list(talks(6))[:400]
    rows = [talk.Reading(None)]
    assert rows[0].row() == (None, 0, 0, 0, 0, 0)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert talk.repair(empty).collect() == [] and talk.repaired_rows(empty).collect() == []
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    assert in_order(talk.repair(df).collect()) == with_hash(diagnosed(data, damage=False))


# --- SimHash

def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def near(rows):
    prints = [fingerprint(t) for _, t in rows]
    bits, root, links = np.array(prints, np.uint64), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 3).tolist():
            if i != j:
                links[i] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)] += [key] if key is not None else []
    return in_order((k, f"{prints[i]:016x}", min(least[find(i)], default=None), links[i]) for i, (k, _) in enumerate(rows))


def near_copies(n):
    rng = random.Random(1)
    base = "the quick brown fox jumps over lazy dog and some more words follow here again".split()
    for i in range(n):
        words = list(base)
        if rng.random() < .7:
            words[rng.randrange(len(words))] = rng.choice("xyz")
        yield 200_000 + i, " ".join(words * 3)


@pytest.mark.parametrize("unit", [1 << 16, 7])
def test_simhash_equals_brute_force(spark, unit):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + list(near_copies(150))
    rows += [(None, None), (99_999, ""), (7, " "), (7, " "), (None, "solo words"), (5, "A b C")]
    assert in_order(simhash.near(extra(spark, rows), unit=unit).collect()) == near(rows)


def test_trie_join_finds_every_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    key = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64))
                                             for _ in range(30)] + [np.arange(2000, dtype=np.uint64)]))
    close = np.bitwise_count(key[:, None] ^ key[None, :]) <= 3
    got = collections.Counter()
    for trie in (0, 1):
        turned = key if not trie else (key << np.uint64(32)) | (key >> np.uint64(32))
        table = simhash.pa.table({"trie": [trie] * len(key), "depth": [0] * len(key), "key": turned.view(np.int64), "copies": [1] * len(key)})
        out = simhash.compared(table).to_pydict()
        got.update(dict(zip(out["node"], out["links"], strict=True)))
    assert got == {k: n - 1 for k, n in zip(key.view(np.int64).tolist(), close.sum(axis=1).tolist(), strict=True) if n > 1}


@pytest.mark.parametrize("unit", [100, 7, 1])
def test_pairs_of_any_bits_are_found_however_deep_the_tables_go(spark, monkeypatch, unit):
    rng = np.random.default_rng(2)
    key = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    bit = [np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64) for _ in range(20)]
    key = np.unique(np.concatenate([key] + [key ^ a ^ b for a, b in zip(bit[::2], bit[1::2], strict=True)]))
    want = (np.bitwise_count(key[:, None] ^ key[None, :]) <= 3).sum(axis=1) - 1
    rows = spark.createDataFrame(list(enumerate(key.view(np.int64).tolist())), "doc_id long, print long")
    monkeypatch.setattr(simhash, "fingerprinted", lambda *_: rows)
    got = {r.doc_id: r.n_links for r in simhash.near(rows, unit=unit).collect()}
    assert got == dict(enumerate(want.tolist()))


def test_simhash_of_an_empty_table_and_of_keyless_rows(spark):
    assert simhash.near(spark.createDataFrame([], EMPTY)).collect() == []
    got = simhash.near(spark.createDataFrame([(None, "a b c d")] * 2, EMPTY)).collect()
    assert [(r.doc_id, r.component_id, r.n_links) for r in got] == [(None, None, 1)] * 2


def test_prints_of_a_very_long_text():
    text = " ".join(f"w{i % 1000}" for i in range(200_000))
    assert simhash.prints([text, "", None]).tolist()[1:] == [0, 0]
    want, upper = simhash.prints([text, text.upper()]).tolist()
    assert want == upper == fingerprint(text)
