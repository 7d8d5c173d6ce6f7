import os

import pytest
from pyspark.sql import functions as F

from labelloom.catalog import inputs
from labelloom.operators import evaluate as E
from labelloom.session import passing_table, remove, checkpoint_dir, scratch_path
from labelloom.sources import sinks, tables
from labelloom.sources.label_files import read_label_file

SCHEMA = "title string, review_id int, text string, label_m double"
TRICKY = [
    ("T1", 1, 'say "hi", ok', 1.0),
    ("T1", 2, "two\nlines;\tand a tab", None),
    (" T2 ", 3, "  edge  ", 0.0),
    ("T3", 4, "back\\slash \\\" end", 2.0),
    ("T4", None, "č,đ", 2.0),
]


@pytest.mark.parametrize("sep", [tables.COMMA, tables.TAB, tables.SEMICOLON])
def test_delimited_round_trip(rows, spark, tmp_path, sep):
    df = rows(TRICKY, SCHEMA).repartition(3)
    sinks.write_delimited(df, str(tmp_path / "t"), sep)
    back = tables.read_delimited(spark, str(tmp_path / "t"), SCHEMA, sep, multi_line=True)
    assert back.dtypes == df.dtypes
    assert sorted(map(tuple, back.collect()), key=str) == sorted(TRICKY, key=str)


def test_foreign_csv_with_byte_order_mark_and_missing_values(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes("﻿title,review_id,text,label_m\r\nT1,1,\"a \"\"b\"\"\nc\",2.0\r\nT2,NA,nan,\r\n".encode())
    got = tables.read_csv(spark, str(path), SCHEMA, multi_line=True).collect()
    assert list(map(tuple, got)) == [("T1", 1, 'a "b"\nc', 2.0), ("T2", None, None, None)]


def test_header_is_normalised(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text(" Text\tLABEL\nab\t1\n")
    df = tables.read_tsv(spark, str(path), "` Text` string, LABEL int")
    assert (df.columns, df.first()) == (["text", "label"], ("ab", 1))


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.csv").write_text("a,b,c\n1,2,3\n")
    (tmp_path / "x" / "2.csv").write_text("a,b,c\n4,5,6\n")
    folder = str(tmp_path / "x")
    assert sorted(tables.read_csv(spark, folder, "c int, a string").collect()) == [(3, "1"), (6, "4")]
    with pytest.raises(ValueError, match="missing columns \\['d'\\]"):
        tables.read_csv(spark, folder, "a int, d int")
    (tmp_path / "x" / "3.csv").write_text("b,a,c\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_csv(spark, folder, "a int").collect()


def test_numbers_are_read_leniently(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("i,l,d\n1.0,9007199254740993,0.5\n2.9,1e3,x\nword,,1e2\n")
    got = tables.read_csv(spark, str(path), "i int, l long, d double").collect()
    assert list(map(tuple, got)) == [(1, 9007199254740993, 0.5), (2, 1000, None), (None, None, 100.0)]


def test_line_breaks_in_fields_are_refused_unless_asked_for(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n"x\ny",2\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_csv(spark, str(path), "a string, b int").collect()
    assert tables.read_csv(spark, str(path), "a string, b int", multi_line=True).collect() == [("x\ny", 2)]


def test_label_file_numbers_lines_over_splits(spark, tmp_path):
    words = ["pozitivno", " 1", "NEG ", "", "2", "   "] * 2000
    path = tmp_path / "labels.txt"
    path.write_bytes("\r\n".join(words).encode())
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        df = read_label_file(spark, str(path))
        got = [tuple(r) for r in df.orderBy("review_order").collect()]
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set(key, before)
    assert got == [(i + 1, v) for i, v in enumerate([2, 1, 0, 2] * 2000)]


def test_label_file_with_unknown_word_raises(spark, tmp_path):
    path = tmp_path / "labels.txt"
    path.write_text("0\nmaybe")
    with pytest.raises(Exception, match="unknown label"):
        read_label_file(spark, str(path)).collect()


def test_splits_are_one_folder_each(rows, spark, tmp_path):
    df = rows([("a", 1, "train"), ("b", 0, "test")], "text string, label int, split string")
    sinks.write_splits(df, str(tmp_path / "s"))
    assert tables.read_csv(spark, str(tmp_path / "s" / "split=test"), "text string, label int").collect() == [("b", 0)]


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_metric_report_sink(rows, spark, tmp_path, form):
    table = E.metric_table(rows([(0, 0), (1, 0)], "t int, p int"), "t", "p")
    sinks.write_metrics(table, str(tmp_path / "m"), form)
    back = spark.read.format(form).load(str(tmp_path / "m")).select(*table.columns)
    assert sorted(back.collect()) == sorted(table.collect())


def test_tables_of_one_row_group_are_dealt_out_by_key(spark, tmp_path, monkeypatch):
    """A file cut into many splits is still one task's work if it is one row group."""
    monkeypatch.setitem(inputs.DEALT, "t", "id")
    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        dealt = inputs.table(spark, str(tmp_path), "t")
        busy = dealt.groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert busy == spark.sparkContext.defaultParallelism
    assert dealt.agg(F.sum("id")).first()[0] == sum(range(20_000))
    spark.range(800).repartition(16).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert inputs.spread(many, "id") is many


def test_scratch_paths_are_fresh(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(checkpoint_dir(spark).rstrip("/"))


def test_label_files_of_many_parts_keep_their_order(spark, tmp_path):
    for k, number in enumerate(("99998", "99999", "100000")):
        (tmp_path / f"part-{number}-x.txt").write_text(f"{k}\n")
    got = read_label_file(spark, str(tmp_path)).orderBy("review_order").collect()
    assert [r["label"] for r in got] == [0, 1, 2]


def test_scratch_tables_are_removed(spark):
    df = spark.range(5)
    with passing_table(df, "gone") as table:
        (place,) = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        assert table.count() == 5 and os.path.isdir(place.removeprefix("file:"))
    assert not os.path.exists(place.removeprefix("file:"))
    kept = scratch_path(spark, "kept")
    df.write.parquet(kept)
    remove(spark, kept)
    assert not os.path.exists(kept.removeprefix("file:"))
