"""Quoted fields with line breaks, read by several tasks per file."""

import random

import pytest

from lurescan.sources import files, quoted

SCHEMA = "id bigint, text string, label int"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def field(rng):
    bits = ["a", "é", "\n", "\n\n", "\r\n", ";", '"', '""', " ", "word ", "\t", "東京", "\\", "'"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))


def written(rows, end="\n", header="id;text;label"):
    wrap = lambda t: "" if t is None else '"' + t.replace('"', '""') + '"'
    return header + end + "".join(f"{i};{wrap(t)};{'' if n is None else n}{end}" for i, t, n in rows)


def rows_of(n, seed):
    """An empty field is NULL, quoted or not, as Spark's own reader has it."""
    rng = random.Random(seed)
    return [(i, rng.choice([field(rng), field(rng), None, "plain"]), rng.choice([0, 1, None])) for i in range(n)]


def read(spark, path):
    return sorted((tuple(r) for r in quoted.read_quoted(spark, str(path), SCHEMA, ";").collect()), key=repr)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_round_trip_over_many_splits(spark, small_splits, tmp_path, end):
    wanted = []
    for k in range(3):
        rows = [(1000 * k + i, t, n) for i, t, n in rows_of(120, k)]
        wanted += rows
        (tmp_path / f"part{k}.csv").write_bytes(written(rows, end).encode())
    df = quoted.read_quoted(spark, str(tmp_path), SCHEMA, ";")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(wanted, key=repr)


def test_equals_the_reader_with_one_task_per_file(spark, small_splits, tmp_path):
    path = tmp_path / "list.csv"
    path.write_bytes((written(rows_of(300, 9)) + '300;"";1\n').encode())
    whole = spark.read.csv(str(path), schema=SCHEMA, sep=";", quote='"', escape='"', header=True, multiLine=True)
    ours = quoted.read_quoted(spark, str(path), SCHEMA, ";")
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, whole.collect()))


def test_a_field_over_many_splits(spark, small_splits, tmp_path):
    long = "\n".join(f"line {i} with some text" for i in range(400))
    rows = [(1, "x", 0), (2, long, 1), (3, long + "\n", 0), (4, "y", 1)]
    path = tmp_path / "a.csv"
    path.write_bytes(written(rows, header='"id\nof";text;"la;bel"').encode())
    assert read(spark, path) == sorted(rows, key=repr)


def test_header_over_a_border_and_blank_lines(spark, small_splits, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(("\n\n\"" + "head\n" * 200 + "\";text;label\n\n 1;a;0\n\n  \n2;\"\n\";1\n\n").encode())
    assert sorted((r[1], r[2]) for r in read(spark, path)) == [("\n", 1), ("a", 0)]


def test_nothing_a_header_alone_and_an_open_field(spark, tmp_path):
    for name, data, rows in [("e.csv", "", []), ("h.csv", "id;text;label\n", []), ("n.csv", "id;text;label", [])]:
        (tmp_path / name).write_text(data)
        assert read(spark, tmp_path / name) == rows
    (tmp_path / "o.csv").write_text('id;text;label\n1;"a";0\n2;"never closed\n3;b;1\n')
    got = read(spark, tmp_path / "o.csv")
    assert got[0] == (1, "a", 0) and len(got) == 2 and "never closed" in got[1][1]


def test_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1;"a\nb";0\n2;c;1')
    df = quoted.read_quoted(spark, str(tmp_path / "a.csv"), SCHEMA, ";", header=False)
    assert sorted(map(tuple, df.collect())) == [(1, "a\nb", 0), (2, "c", 1)]


def test_url_list(spark, small_splits, tmp_path):
    urls = [(f"http://a/{i}\n\"{'x' * (i % 50)};" if i % 3 else f"http://b/{i}", i % 2) for i in range(200)]
    df = spark.createDataFrame(urls, "url string, label int")
    files.write_table(df.coalesce(1), str(tmp_path / "list"), sep=";")
    back = files.read_url_list(spark, str(tmp_path / "list"))
    assert sorted(map(tuple, back.collect())) == sorted(urls)
    assert back.schema == df.schema
