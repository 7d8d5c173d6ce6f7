"""Quoted records with line breaks, one file over many tasks."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from labelloom.sources import tables
from labelloom.sources.quoted import Scanner, records, split_states, _lines


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(rows, sep, end="\r\n", header=("a", "b", "c")):
    out = io.StringIO()
    made = csv.writer(out, delimiter=sep, lineterminator=end)
    made.writerow(header)
    made.writerows(rows)
    return out.getvalue()


def made(seed, n):
    rng = random.Random(seed)
    parts = ["x", "word", " ", "\n", '"', '""', ",", ";", "\t", "\n\n", "é", "long text " * 5, "\n" * 7]
    return [tuple("".join(rng.choices(parts, k=rng.randint(1, 9))) + "." for _ in range(2)) + (str(i),) for i in range(n)]


@pytest.mark.parametrize("sep, end", [(",", "\n"), (";", "\r\n"), ("\t", "\n")])
def test_one_file_over_many_tasks(spark, tmp_path, small_splits, sep, end):
    rows = made(len(end), 150)
    (tmp_path / "one.csv").write_text("﻿" + written(rows, sep, end), encoding="utf-8", newline="")
    (tmp_path / "two.csv").write_text(written(rows[:3], sep, end), encoding="utf-8", newline="")
    assert _lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    got = tables.read_delimited(spark, str(tmp_path), "a string, b string, c int", sep, multi_line=True)
    want = [(a, b, int(c)) for a, b, c in rows + rows[:3]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    states = split_states(_lines(spark, str(tmp_path)), sep).collect()
    assert any(r["before"] for r in states)


def test_one_record_over_many_splits(spark, tmp_path, small_splits):
    """A field with a third of the file, empty lines, quotes in unquoted fields and none at the file's end."""
    long = "\n".join(f'line {i}, "quoted" text' for i in range(200))
    text = "a,b,c\n\n" + '1,5" disk,x\n' + written([("2", long, "y")], ",", "\n").split("\n", 1)[1] + '\n3,"",\n4,6" x 7",z'
    (tmp_path / "t.csv").write_text(text, encoding="utf-8", newline="")
    got = tables.read_csv(spark, str(tmp_path), "a int, b string, c string", multi_line=True)
    want = {1: ('5" disk', "x"), 2: (long, "y"), 3: (None, None), 4: ('6" x 7"', "z")}
    assert {r["a"]: (r["b"], r["c"]) for r in got.collect()} == want


def test_same_rows_as_one_task(spark, tmp_path, small_splits):
    rows = made(5, 60)
    (tmp_path / "t.csv").write_text(written(rows, ",", "\n"), encoding="utf-8", newline="")
    got = tables.read_csv(spark, str(tmp_path), "a string, b string, c string", multi_line=True)
    plain = spark.read.csv(str(tmp_path), header=True, quote='"', escape='"', multiLine=True, schema="a string, b string, c string")
    assert sorted(got.collect()) == sorted(plain.collect())


def test_other_headers_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("a,z\n1,2\n")
    with pytest.raises(Exception, match="does not have the header"):
        tables.read_csv(spark, str(tmp_path), "a int, b int", multi_line=True).collect()


def test_empty_and_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    (tmp_path / "b.csv").write_text("")
    got = tables.read_csv(spark, str(tmp_path), "a int, b int", multi_line=True)
    assert got.count() == 0 and got.columns == ["a", "b"]


@pytest.mark.parametrize(
    "line, after",
    [("a,b", (0, 1)), ('a,"b', (1, 0)), ('a,"b"', (0, 0)), ('"', (1, 0)), ('5" x', (0, 0)), ('""', (0, 1)), ('"a""', (1, 0)), ('x","y', (1, 1)), ('","', (0, 1))],
)
def test_states(line, after):
    scan = Scanner(",")
    assert (scan.after(0, line), scan.after(1, line)) == after


def test_records_of_a_split_are_counted(spark, tmp_path):
    (tmp_path / "t.csv").write_text('h\n"a\nb"\nc\n')
    got = records(spark, str(tmp_path), ",").orderBy(F.length("record"), "record").collect()
    assert [(r["first"], r["record"]) for r in got] == [(False, "c"), (True, "h"), (False, '"a\nb"')]
