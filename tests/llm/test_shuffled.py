"""Operators that move data: repeats, fingerprints, packing, Jaccard join, WARC, and the pipeline, against brute force."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from synthmill.llm import blocks, components, fingerprints, jaccard, packing, quality, repeats, secrets, warc
from synthmill.llm.queries import QUERIES
from tests.conftest import SF

EMPTY = "doc_id long, text string"
sha = lambda b: hashlib.sha256(b).hexdigest()


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def copies(seed, n):
    """Exact and near copies, shared passages and lines, short and empty texts; null and repeated keys."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdÉ") for _ in range(rng.randint(1, 6))) for _ in range(70)]
    bases = [prose(rng, words, rng.choice([8, 30, 100, 200])) for _ in range(12)]
    passages = [prose(rng, words, 30) for _ in range(4)]
    lines = [prose(rng, words, 12) for _ in range(8)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < .15:
            text = rng.choice(bases)
        elif kind < .5:
            edited = rng.choice(bases).split()
            for _ in range(rng.randint(1, max(1, len(edited) // 25))):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            text = " ".join(edited)
        elif kind < .65:
            text = prose(rng, words, rng.randint(0, 60)) + " " + rng.choice(passages) + rng.choice(["", "x", " "]) + prose(rng, words, rng.randint(0, 60))
        elif kind < .8:
            text = "\n".join(rng.choice(lines) for _ in range(rng.randint(3, 8)))
        elif kind < .9:
            text = rng.choice(["", None, "one", "a b c d", "a b c d e", " \t\n", "É é", "the " * 60, "ab" * 100, "x" * 49, "x" * 50, "x" * 51, "é" * 60])
        else:
            text = prose(rng, words, 60)
        rows.append((rng.choice([None, i, i, i, i, i, i, i - 1]), text))
    return rows


def frame(spark, rows):
    wide = [(a, b, "x", 1) for a, b in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, block string, node int").repartition(4)


# --- repeats

def without_repeats(rows):
    keyed = [(2**63 - 1 if k is None else k, (t or "").encode()) for k, t in rows]
    first: dict[bytes, int] = {}
    for key, raw in keyed:
        for p in range(len(raw) - 49):
            first[raw[p:p + 50]] = min(first.get(raw[p:p + 50], 2**63), key)
    for key, raw in keyed:
        mask = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p:p + 50]] < key:
                mask[p:p + 50] = True
        yield raw, mask


def removal(raw, mask):
    spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
    return len(raw), int(mask.sum()), spans, sha(np.frombuffer(raw, np.uint8)[~mask].tobytes())


@pytest.mark.parametrize("crowd", [repeats.CROWDED, 3])
def test_repeats_equal_brute_force(spark, crowd):
    rows = copies(11, 200)
    want = sorted(str((r[0], *removal(*x))) for r, x in zip(rows, without_repeats(rows), strict=True))
    assert sorted(str(tuple(r)) for r in repeats.dedup(frame(spark, rows), crowd=crowd).collect()) == want


def test_repeats_of_texts_that_end_in_nul_bytes(spark):
    rng = random.Random(0)
    rows = []
    for trial in range(8):
        shared = "".join(rng.choice("abcdef") for _ in range(rng.randint(45, 69)))
        for _ in range(8):
            lead = "".join(rng.choice("xyz") for _ in range(rng.randrange(30)))
            rows.append((len(rows), lead + shared + "\0" * rng.randrange(12)))
    want = sorted(str((r[0], *removal(*x))) for r, x in zip(rows, without_repeats(rows), strict=True))
    assert sorted(str(tuple(r)) for r in repeats.dedup(frame(spark, rows)).collect()) == want


def test_repeats_of_the_query_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((d[0], *removal(*x)) for d, x in zip(docs, without_repeats(docs), strict=True))
    assert sorted(tuple(r) for r in QUERIES["op1_suffix_dedup"](spark, SF).collect()) == want


def test_trimmed_texts_keep_whole_characters_and_columns(spark):
    rows = [(i, t) for i, (_, t) in enumerate(copies(12, 150))]
    out = repeats.trimmed(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "block", "node"]
    want = {}
    for (key, text), (raw, mask) in zip(rows, without_repeats(rows), strict=True):
        left, at = "", 0
        for c in text or "":
            n = len(c.encode())
            left += "" if mask[at:at + n].all() else c
            at += n
        if left or not text:
            want[key] = None if text is None else left
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_groups_have_all_occurrences(spark):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    passage = prose(rng, words, 12)  # 71 bytes: within a fragment
    docs = {i: f"{prose(rng, words, rng.randint(0, 20))} {i}{passage}{i} {prose(rng, words, 5)}" for i in range(12)}
    found = repeats.repeat_groups(frame(spark, list(docs.items()))).collect()
    by = collections.defaultdict(set)
    for r in found:
        raw = docs[r.doc_id].encode()
        by[r.repeat].add((r.doc_id, raw[r.start:r.start + r.length]))
    assert all(len({s for _, s in x}) == 1 for x in by.values())
    covered = {i: set() for i in docs}
    for r in found:
        covered[r.doc_id].update(range(r.start, r.start + r.length))
    for i, text in docs.items():
        at = text.index(passage)
        assert covered[i] >= set(range(at, at + len(passage)))
    assert all(len(x) == len(docs) for s, x in by.items() if next(iter(x))[1] in passage.encode() and len(next(iter(x))[1]) >= 50)


def test_groups_of_copies_and_inside_a_text(spark):
    """Exact copies without another partner, and a passage of 500 bytes twice in one text, are covered; single passages are not."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    copy, passage, alone = (prose(rng, words, n) for n in (30, 84, 40))
    docs = {0: copy, 1: copy, 2: f"{passage} 2 {prose(rng, words, 20)} 2 {passage}", 3: alone, 4: f"{copy[:40]} 4"}
    found = repeats.repeat_groups(frame(spark, list(docs.items()))).collect()
    places, covered = collections.defaultdict(set), {i: set() for i in docs}
    for r in found:
        places[r.repeat].add((r.doc_id, r.start))
        covered[r.doc_id].update(range(r.start, r.start + r.length))
    assert all(len(x) > 1 for x in places.values())
    assert covered[0] == covered[1] == set(range(len(copy))) and not covered[3] and not covered[4]
    assert len(passage) > 490 and covered[2] >= {*range(len(passage)), *range(len(docs[2]) - len(passage), len(docs[2]))}


def test_interval_scan_equals_brute_force():
    rng = random.Random(14)
    for _ in range(60):
        texts = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 80))) for _ in range(3)})
        seed = bytes(rng.choice(b"ab") for _ in range(75))
        texts += [seed[:rng.randint(50, 75)] + bytes(rng.choice(b"ab") for _ in range(5)) for _ in range(4)] + [b"a" + seed[:70]]
        texts = list(dict.fromkeys(t[:80] for t in texts))
        low = np.array([rng.randint(0, 9) for _ in texts])
        high = low + np.array([rng.choice([0, 0, 3]) for _ in texts])
        marked = collections.defaultdict(set)
        for k, o, ell, least in repeats.groups_of(texts, low, high):
            assert ell >= 50 and high[k] > least
            for key in range(least + 1, int(high[k]) + 1):
                marked[k, key].update(range(o, o + ell))
        for k, text in enumerate(texts):
            for key in {int(low[k]), int(high[k])}:
                want = set()
                for p in range(len(text) - 49):
                    if any(text[p:p + 50] in t and low[j] < key for j, t in enumerate(texts) if j != k):
                        want.update(range(p, p + 50))
                assert marked[k, key] >= want and (marked[k, key] == want or low[k] < key)


# --- shared keys of blocks

def test_shared_keys(spark):
    rng = np.random.default_rng(1)
    keys = {b: rng.integers(0, 300, 120).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for b in range(4)}
    parts = 3
    import pyarrow as pa
    asked = pa.concat_tables([blocks.asked(b, *blocks.summed(blocks.codes(k, parts), np.ones(len(k), np.int64))) for b, k in keys.items()])
    out = blocks.shared_keys(spark.createDataFrame(asked)).toArrow()
    totals = collections.Counter(np.concatenate(list(keys.values())).tolist())
    for b, k in keys.items():
        known, values = blocks.told(out.filter(pa.compute.equal(out.column("block"), b)))
        got = blocks.looked_up(blocks.codes(k, parts), known, values, 1)
        assert got.tolist() == [max(totals[x], 1) for x in k.tolist()]


# --- fingerprints

def test_fingerprints_equal_brute_force(spark):
    rows = [(k, t) for k, t in copies(21, 120)] + [(10**18, "far " * 50), (-7, "neg"), (2**40, "mid"), (-(2**50), "low" * 40)]
    order = sorted([(k, t or "") for k, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), [-b for b in r[1].encode()] + [1]))
    want = []
    for i, (key, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = (text[:len(text) - half] + following[:half])
        f, e, n = (fingerprints.fingerprint(x.encode()) for x in (text, edited, following))
        want.append((key, len(text), sha(edited.encode()), fingerprints.spelled(f), fingerprints.spelled(e),
                     fingerprints.containment(f, e), fingerprints.containment(f, n), len(f)))
    assert sorted(str(tuple(r)) for r in fingerprints.compared(frame(spark, rows)).collect()) == sorted(map(str, want))


def test_boundaries_follow_the_rule():
    rng = random.Random(22)
    for n in (0, 1, 31, 32, 33, 64, 500, 5000):
        data = bytes(rng.randrange(256) for _ in range(n))
        ends, start = [], 0
        gear = fingerprints.GEAR.tolist()
        while start < n:
            end, h = min(start + fingerprints.MOST, n), 0
            if n - start <= fingerprints.LEAST:
                end = n
            else:
                for p in range(max(0, start + fingerprints.LEAST - 32), end):
                    h = ((h << 1) + gear[data[p]]) & 0xFFFFFFFF
                    size = p + 1 - start
                    bits = fingerprints.RARE_BITS if size < fingerprints.NORMAL else fingerprints.FREQUENT_BITS
                    if size >= fingerprints.LEAST and h >> (32 - bits) == 0:
                        end = p + 1
                        break
            ends.append(end)
            start = end
        assert fingerprints.boundaries(data) == ends


def test_fingerprints_stand_shifts(spark):
    rng = random.Random(23)
    text = "".join(rng.choice("abcdefghij ") for _ in range(20_000))
    f, g = fingerprints.fingerprint(text.encode()), fingerprints.fingerprint(f"new start {text[:9000]} middle {text[9000:]}".encode())
    assert fingerprints.containment(f, g) > 0.95
    both = spark.createDataFrame([(0, text, text[:5000]), (1, "", ""), (2, "", "x"), (3, None, None)], "doc_id long, a string, b string")
    left, right = (fingerprints.fingerprints(both, text_col=c).withColumnRenamed("chunks", c) for c in "ab")
    got = {r.doc_id: r.x for r in left.join(right, "doc_id").select("doc_id", fingerprints.likeness("b", "a").alias("x")).collect()}
    assert got[0] > 0.95 and got[1] == got[3] == 1.0 and got[2] == 0.0


def test_before_finds_the_next_smaller_key(spark):
    rng = random.Random(24)
    keys = sorted({rng.randint(-2**62, 2**62) >> rng.choice([0, 20, 40, 55]) for _ in range(300)})
    got = {r.k: r.before for r in fingerprints.before(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()}
    assert got == dict(zip(keys, [None, *keys]))


# --- packing

def fewest(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + items[i] <= capacity:
                go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1:]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_reduction_fixes_only_what_an_optimum_has():
    rng = random.Random(31)
    for _ in range(300):
        items = sorted((rng.randint(1, 30) for _ in range(rng.randint(0, 10))), reverse=True)
        counts = dict(collections.Counter(items))
        instance = packing.Instance(counts, 30)
        instance.reduce()
        rest = [w for w, n in instance.left.items() for _ in range(n)]
        assert sum(n for _, n in instance.made) + fewest(sorted(rest, reverse=True), 30) == fewest(items, 30)
        made = packing.packed_lengths(counts, 30)
        assert sorted(x for lengths, n in made for x in lengths * n) == sorted(items)
        assert all(sum(lengths) <= 30 for lengths, _ in made)


def packed_right(rows, texts):
    """Every piece is right and every sequence is filled without gaps; returns the number of sequences."""
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for key, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        short = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        for k, n in enumerate(([short] if short else []) + [1024] * ((len(ids) - short) // 1024)):
            want.append((key, k, start, n, zlib.crc32(ids[start:start + n].tobytes())))
            start += n
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    return len(sequences)


def test_packing_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op5_packing"](spark, SF).collect()
    n = packed_right(rows, texts)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def test_packing_of_odd_tables(spark):
    rows = [(1, None), (2, ""), (None, "a <|endoftext|> b"), (3, "word " * 5000), (3, "word " * 5000), (4, "x y " * 511 + "z"), (5, "w" * 3000), *[(i, "same text") for i in range(40)]]
    packed_right(packing.pack(frame(spark, rows), P.path("byte_bpe_50k.json"), P.PATTERN).collect(), rows)


# --- Jaccard join

def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def joined(rows):
    sets, root, links = [shingles(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
                links[i], links[j] = links[i] + 1, links[j] + 1
    least: dict[int, int] = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least.get(find(i)), links[i]) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize("block_sets", [jaccard.BLOCK_SETS, 3])
def test_jaccard_equals_brute_force(spark, monkeypatch, block_sets):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block_sets)
    rows = [(None if k is None else i, t if random.Random(i).random() > .1 else (t or "").upper()) for i, (k, t) in enumerate(copies(41, 400))]
    assert sorted(str(tuple(r)) for r in jaccard.linked(frame(spark, rows)).collect()) == sorted(map(str, joined(rows)))


def test_jaccard_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op8_ngram_jaccard"](spark, SF).collect()) == sorted(joined(docs))


def test_jaccard_tells_texts_of_one_key_apart(spark):
    a, b, c = (prose(random.Random(i), letters, 30) for i, letters in enumerate(("abcdefghijk", "lmnopqrstuv", "xyzäöüàéèß")))
    rows = [(5, a), (5, b), (7, a), (9, b), (3, b), (5, a), (5, c), (None, a), (None, "only me here")]
    got = sorted(str(tuple(r)[:3]) for r in jaccard.linked(frame(spark, rows)).collect())
    assert got == sorted(str(x[:3]) for x in joined(rows)) and "(5, 26, 3)" in got and got.count("(5, 26, 5)") == 3
    left = jaccard.one_each(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, __id string, component int"))
    assert sorted(str(tuple(r)) for r in left.collect()) == sorted(str((*r, "x", 1)) for r in [(5, a), (3, b), (5, c), (None, a), (None, "only me here")])


@pytest.mark.parametrize("paired", [1, 2, 256])
def test_lists_are_paired_by_parts(spark, monkeypatch, paired):
    """Every two blocks of a list, and each with itself, once, whatever the parts it is cut into."""
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 2)
    reps = spark.createDataFrame([(i, 4 + i % 5, [1, 2 + i % 3]) for i in range(40)], "node long, n long, keys array<long>")
    placed, pairs = jaccard.shared_blocks(reps)
    of = {r.node: r.block for r in placed.collect()}
    bucket = {i: int(math.log(4 + i % 5) / math.log(jaccard.RATIO)) for i in range(40)}
    want = {tuple(sorted((of[i], of[j]))) for i in range(40) for j in range(40) if abs(bucket[i] - bucket[j]) <= 1}
    got = [tuple(sorted(r)) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_hub_and_its_copies(spark):
    """Copies that are like the original but not like each other: pairs differ from lists."""
    rng = random.Random(42)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = base[:]
        for at in rng.sample(range(200), 4):
            w[at] = f"v{i}-{at}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in jaccard.linked(frame(spark, rows)).collect())
    assert got == sorted(joined(rows)) and {r[2] for r in got} == {0}


def test_components(spark):
    rng = random.Random(43)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(200)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in got} and got.keys() >= {x for u, v in edges if u != v for x in (u, v)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- WARC

def test_warc_round_trip(spark, tmp_path):
    long = "é😀" * 30_000
    rows = [(1, None, None), (2, "u\r\nv", long), (3, "u", long), (3, "u", long), (2, "u", long), (None, "u", long), (5, "u", "x" * 99), (6, "u", "x" * 99),
            (7, "u", "y" * 100), (8, None, "y" * 100), (9, "u", "WARC/1.1\r\n\r\n\r\n0\r\n\r\n" * 20), (2, "u", "other text")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, block string").repartition(3)
    least: dict[str, int] = {}
    for key, _, html in rows:
        if key is not None and len((html or "").encode()) >= 100:
            least[html] = min(least.get(html, key), key)
    want = []
    for key, _, html in rows:
        raw = (html or "").encode()
        first = least.get(html)
        again = first is not None and first != key
        want.append((key, len(raw), sha(raw), "revisit" if again else "response", first if again else None, True))
    out = warc.archived(df, str(tmp_path))
    got = [(*tuple(r)[:5], r.complete) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert max(r.n_segments for r in out.collect()) > 3
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path)).count() == 0


def test_warc_tells_what_is_missing():
    block = warc.HTTP_HEAD + warc.CHUNKED + b"\r\n" + warc.chunked(b"payload" * 50, 64)
    part = lambda n, data, total: {"segment": n, "total": total, "block": data, "page_id": 1, "record_type": "response", "refers_to": None,
                                   "payload_bytes": 350, "payload_digest": sha(b"payload" * 50)}
    whole = [part(2, block[100:200], None), part(1, block[:100], None), part(3, block[200:], len(block))]
    assert warc.restored(whole)[0] == (1, 350, sha(b"payload" * 50), "response", None, 3, True)
    assert not warc.restored(whole[:2])[0][-1] and not warc.restored([whole[1], whole[2]])[0][-1]
    assert not warc.restored([*whole[:2], part(3, block[200:], len(block) + 1)])[0][-1]
    assert warc.restored(whole[:2])[0][1:3] == (None, None)
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


@pytest.mark.parametrize("lost", ["a segment", "bytes"])
def test_warc_reads_what_is_left_of_an_archive(spark, tmp_path, lost):
    """A page of which a record is gone or changed is not complete; the others are as they were."""
    pages = spark.createDataFrame([(1, "u", "a" * 50_000), (2, "v", "b" * 50_000), (3, "w", "short")], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"), date="2024-01-01T00:00:00Z")
    [file] = (tmp_path / "a").glob("*.gz")
    raw = gzip.decompress(file.read_bytes())
    records = raw.split(warc.RECORD_END.encode() + warc.VERSION.encode())
    assert all(b"WARC-Date: 2024-01-01T00:00:00Z" in r and b"WARC-Target-URI: " in r for r in records)
    at = next(i for i, r in enumerate(records) if b"WARC-Segment-Number: 2" in r and b"page:2:" in r)
    records[at:at + 1] = [] if lost == "a segment" else [records[at].replace(b"b" * 100, b"c" * 100)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.warc.gz").write_bytes(gzip.compress((warc.RECORD_END.encode() + warc.VERSION.encode()).join(records)))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.complete) for r in warc.read_archives(spark, str(tmp_path / "b")).collect()}
    assert got == {1: (50_000, sha(b"a" * 50_000), True), 2: (None, None, False), 3: (5, sha(b"short"), True)}


def test_warc_query(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op9_warc"](spark, SF).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in got} == {k: (len(v), sha(v)) for k, v in pages.items()}


# --- the pipeline

def test_pipeline_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = [d for d, ok in zip(docs, quality.judged([t for _, t in docs])["kept"], strict=True) if ok]
    alone = [d for d, j in zip(kept, joined(kept), strict=True) if j[0] == j[2]]
    left = []
    for (key, text), (raw, mask) in zip(alone, without_repeats(alone), strict=True):
        cut, at = "", 0
        for c in text:
            n = len(c.encode())
            cut += "" if mask[at:at + n].all() else c
            at += n
        if cut:
            left.append((key, cut))
    masked = {r.doc_id: r.text for r in secrets.masked(spark.createDataFrame(left, EMPTY)).collect()}
    packed_right(corpus_pipeline.run(spark, SF).collect(), list(masked.items()))


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


def test_stages_take_nulls(spark):
    rows = [(None, None, None, None, None), (1, None, "en", None, 5), (None, "x " * 80, None, "s", None), (2, " ".join(map(str, range(90))), None, None, None),
            (2, " ".join(map(str, range(90))), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()


def test_empty_tables(spark):
    df = spark.createDataFrame([], EMPTY)
    for out in (repeats.dedup(df), repeats.trimmed(df), repeats.repeat_groups(df), fingerprints.compared(df), fingerprints.fingerprints(df),
                jaccard.linked(df), jaccard.one_each(df), packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN)):
        assert out.collect() == []
