"""Quoted line breaks: splits read apart give what a reader of the whole file gives."""

import random

import pytest

from sparkscrub.session import fresh_path
from sparkscrub.sources import delimited, quoted
from tests.test_hard_cases import put

OPTIONS = {"escape": '"', "mode": "PERMISSIVE"}


def cell(rng):
    kind = rng.randrange(8)
    if kind == 0:
        return '"' + rng.choice(["a\nb", 'say ""x""\n', "\n\n", 'x,"",\ny', "\r\nz", "l" * 90 + "\n" + "m" * 90]) + '"'
    if kind == 1:
        return rng.choice(['5"', 'a"b', 'x""y', '', '""', '"p, q"', '"ab"cd', ' "s'])
    return rng.choice(["1", "word", "x y", "é", "", "2024-01-01"])


def text(rng, rows, end="\n"):
    return end.join(["h1,h2,h3", *(",".join(cell(rng) for _ in range(3)) for _ in range(rows))]) + rng.choice(["", end])


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_the_whole_file_reader(spark, small_splits, seed):
    rng = random.Random(seed)
    folder = fresh_path(spark, "quoted")
    for k in range(3):
        put(spark, folder, f"part {k}.csv", text(rng, rng.choice([0, 3, 120])).encode())
    schema = "c0 string, c1 string, c2 string, c3 string, c4 string"
    want = spark.read.options(multiLine="true", header="true", enforceSchema="true", **OPTIONS).schema(schema).csv(folder)
    got = quoted.read(spark, [folder], ",", "UTF-8", 5, OPTIONS)
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_as_many_tasks_as_splits(spark, small_splits):
    folder = fresh_path(spark, "quoted")
    body = "a,b\n" + "".join(f'{i},"line {i}\nand more of it, ""{i}"""\n' for i in range(400))
    path = put(spark, folder, "big.csv", body.encode())
    df = delimited.read_text_table(spark, path)
    splits = -(-len(body) // 300)
    assert quoted._lines(spark, [path]).rdd.getNumPartitions() >= splits - 1
    rows = {r["a"]: r["b"] for r in df.collect()}
    assert len(rows) == 400 and all(v == f'line {k}\nand more of it, "{k}"' for k, v in rows.items())


def test_records_over_many_splits_and_open_ends(spark, small_splits):
    folder = fresh_path(spark, "quoted")
    long = "\n".join(f"row {i} of a long cell" for i in range(200))
    path = put(spark, folder, "long.csv", f'"h\n1",h2\n1,"{long}"\n2,x\n3,"never closed\nto the end'.encode())
    got = sorted(map(tuple, quoted.read(spark, [path], ",", "UTF-8", 2, OPTIONS).collect()))
    assert got == [("1", long), ("2", "x"), ("3", "never closed\nto the end")]


def test_other_encodings(spark):
    path = put(spark, fresh_path(spark, "quoted"), "w.csv", 'n;t\n1;"café\n€ 5"\n'.encode("cp1252"))
    assert [tuple(r) for r in delimited.read_text_table(spark, path).collect()] == [("1", "café\n€ 5")]


@pytest.mark.parametrize("line,plain,inside", [
    (b"a,b", False, True), (b'"a', True, False), (b'a"', False, False), (b'"a","b', True, True), (b'""', False, True), (b'"a""', True, False), (b'x,"', True, False), (b'",', False, False),
    (b'","', True, True), (b'a""b,"c', True, True)])
def test_state_of_a_line(line, plain, inside):
    """Both starts, told apart by a plain loop over characters."""
    def loop(open_):
        start, k = not open_, 0
        while k < len(line):
            c = line[k:k + 1]
            if open_:
                if c == b'"' and line[k + 1:k + 2] == b'"':
                    k += 1
                elif c == b'"':
                    open_ = False
                start = False
            elif c == b'"' and start:
                open_, start = True, False
            else:
                start = c == b","
            k += 1
        return open_

    assert (quoted.inside_after(line, False, b","), quoted.inside_after(line, True, b",")) == (loop(False), loop(True))
