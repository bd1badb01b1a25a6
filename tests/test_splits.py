"""CSV files cut into blocks of a few bytes, against Spark's own reader of whole files."""

import random

import pyarrow as pa
import pytest

from synthmill.sources import files as S, splits

FORM = dict(header=True, comment="#", quote='"', escape='"', multiLine=True, ignoreTrailingWhiteSpace=True, emptyValue="")


@pytest.fixture
def small_blocks(spark):
    """Blocks of 40 bytes: the tests' files fall into dozens."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("40", "1")):
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def whole(spark, path):
    return spark.read.csv(path, **FORM).na.fill("")


def cell(rng):
    plain = "".join(rng.choice(["a", "b1", " ", "  ", "é", "x\ty", "#", "-"]) for _ in range(rng.randrange(4))).lstrip()
    kind = rng.randrange(6)
    if kind < 3:
        return plain.lstrip("#") if kind == 0 else plain
    inner = "".join(rng.choice(["a", ",", '""', "\n", "\n\n", "#b", "\n#c", " d", '"",""', "long text of a cell "]) for _ in range(rng.randrange(1, 7)))
    return f'"{inner}"'


def document(rng, newline="\n"):
    lines = ["# a comment, with \"one quote", "", "id,one,two"]
    for i in range(rng.randrange(1, 40)):
        if rng.random() < 0.1:
            lines.append(rng.choice(["# note \"", "", "#"]))
        lines.append(f"{i},{cell(rng)},{cell(rng)}" if rng.random() < 0.9 else f'{i},"only')
        if lines[-1].endswith('"only'):
            lines[-1] += "\n" * rng.randrange(1, 90) + f'text",{cell(rng)}'
    text = "\n".join(lines) + rng.choice(["", "\n"])
    return text.replace("\n", newline)


@pytest.mark.parametrize("seed", (2, 3))
def test_blocks_give_the_rows_of_the_whole_file(small_blocks, tmp_path, seed):
    rng = random.Random(seed)
    for i in range(2):
        (tmp_path / f"{i}.csv").write_bytes(document(rng, "\r\n" if seed == 3 else "\n").encode())
    got = S.read_csv(small_blocks, str(tmp_path))
    assert got.columns == ["id", "one", "two"]
    assert rows(got) == rows(whole(small_blocks, str(tmp_path)))


def test_a_cell_longer_than_many_blocks(small_blocks, tmp_path):
    text = "\n".join(f"line {i}, \"\"{i}\"\"" for i in range(50))
    (tmp_path / "a.csv").write_text(f'id,note\n1,"{text}"\n2,"b"\n3,c\n4,"d\n')
    got = S.read_csv(small_blocks, str(tmp_path / "a.csv"))
    assert rows(got)[:3] == [("1", text.replace('""', '"')), ("2", "b"), ("3", "c")] and rows(got)[3:] == [("4", "d")]
    lines = small_blocks.read.text(str(tmp_path / "a.csv"), lineSep="\n")
    assert lines.rdd.getNumPartitions() > 20


def test_many_tasks_and_rows_of_each_block_once(small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n" + "".join(f'{i},"v,{i}"\n' for i in range(90)))
    got = S.read_csv(small_blocks, str(tmp_path / "a.csv"))
    assert rows(got) == sorted((str(i), f"v,{i}") for i in range(90))
    assert got.rdd.getNumPartitions() > 20


def test_rows_do_not_depend_on_the_join(small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text(document(random.Random(9))[:900])
    want = rows(S.read_csv(small_blocks, str(tmp_path)))
    small_blocks.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(S.read_csv(small_blocks, str(tmp_path))) == want
    finally:
        small_blocks.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_folders_and_odd_files(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9")
    try:
        odd_files(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def odd_files(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / "t" / f"k={k}").mkdir(parents=True)
        (tmp_path / "t" / f"k={k}" / "a.csv").write_text(f'id,note\n{k},"x\ny"\n')
    got = S.read_csv(spark, str(tmp_path / "t"))
    assert got.columns == ["id", "note", "k"]
    assert rows(got) == [("1", "x\ny", 1), ("2", "x\ny", 2)]
    (tmp_path / "head.csv").write_text("a,b\n")
    assert rows(S.read_csv(spark, str(tmp_path / "head.csv"))) == []
    (tmp_path / "head.csv").write_text('"a\nb",c\n1\n2,3,4\n')
    got = S.read_csv(spark, str(tmp_path / "head.csv"))
    assert got.columns == ["a\nb", "c"] and rows(got) == [("1", ""), ("2", "3")]
    (tmp_path / "none.csv").write_text("a,b\n1,2\n\n#x\n3\n")
    assert not splits.has_quotes(spark, str(tmp_path / "none.csv"))
    assert rows(S.read_csv(spark, str(tmp_path / "none.csv"))) == [("1", "2"), ("3", "")]


def test_small_files_are_left_to_the_whole_file_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"x\ny"\n')
    assert not splits.larger_than_a_block(spark, str(tmp_path))
    got = S.read_csv(spark, str(tmp_path))
    assert rows(got) == [("1", "x\ny")] and "MapInArrow" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", range(40))
def test_states_by_quotes_equal_states_by_patterns(seed):
    """Lines in batches of any size through a block: the vector steps against the patterns, line by line."""
    rng = random.Random(seed)
    pieces = ['"', '"', ',', '""', 'a', '#', '",', ',"', "\r", "é"]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(1, 80))]
    if seed % 2:
        lines = document(rng, rng.choice(["\n", "\r\n"])).split("\n")
    first = seed % 4 == 0
    block, rows, whole, at = splits._Block(first), [], [], 0
    told = []
    while at < len(lines):
        size = rng.randrange(1, 30)
        told += block.take(pa.array(["x", *lines[at:at + size]]).slice(1))
        at += size
    for part in [*told, *block.rest()]:
        if isinstance(part, list):
            rows += zip(*(c.tolist() for c in part))
        else:
            whole += part.to_pylist()
    want = []
    for inside in (False, not first):
        states, start = [], -1
        for n, text in enumerate(lines):
            start = start if inside else n
            after = (splits.STAYS if inside else splits.OPENS).match(text) is not None
            states.append((inside, after, start))
            inside = after
        want.append(states)
    *rows, end = rows
    assert (end[0], end[1]) == (len(lines), None) and end[4:6] == (want[0][-1][1], want[1][-1][1])
    used = set()
    for n, text, *flags in rows:
        last = n + text.count("\n")
        used |= set(range(n, last + 1))
        assert text == "\n".join(lines[n:last + 1])
        (out, into) = ((s[n][0], s[last][1], s[n][2]) for s in want)
        assert flags == [out[0], into[0], out[1], into[1], out[2], into[2]]
        assert last == n or not any(flags[:4]) and all(s[i][1] for s in want for i in range(n, last))
    # The other lines are the records of both assumptions, in order.
    records = []
    for n in (n for n in range(len(lines)) if n not in used):
        if want[0][n][0]:
            records[-1] += "\n" + lines[n]
        else:
            records.append(lines[n])
        assert want[0][n] == want[1][n]
    assert whole == records


def test_transitions():
    opens = lambda t: splits.OPENS.match(t) is not None
    stays = lambda t: splits.STAYS.match(t) is not None
    assert [opens(t) for t in ('a,"b', 'a,"b"', 'a,"b"",c', '#"', 'a"b', '"a"b,"', '"', '""', '"a",')] == [True, False, True, False, False, True, True, False, False]
    assert [stays(t) for t in ('', 'a""', 'a"', 'a",', 'a","b', 'a"b,c', '""",x', '#')] == [True, True, False, False, True, False, False, True]
    assert opens('a,"' + '""' * 500_000) and not stays("x" * 1_000_000 + '",' * 499_999)
