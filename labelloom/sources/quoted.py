"""Delimited files whose quoted fields hold line breaks, read by many tasks for one file.

A line alone does not tell whether it begins a record: that depends on all quotes before it. Every line
is therefore a function of two states, between records and inside quotes, and so is every split, as a
composition of its lines. Splits are read once for their functions (only lines with a quote matter), a
prefix scan over the splits of a file gives the state that each begins in, and a second pass cuts every
split into records. A record that crosses the border of a split comes as fragments, at most two a
split, which are put together by a shuffle of those alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.session import cut_lineage

QUOTE = '"'
BOM = "\ufeff"
WHOLE, PIECE = 0, 1
_INSIDE = re.compile('(?:[^"]++|"")*+"')

RECORDS = "file string, start long, number int, kind int, opens boolean, record string"


def _fields(sep: str) -> tuple[re.Pattern, re.Pattern]:
    """Patterns for the rest of a field with the fields after it, and for whole fields, up to the line end.

    A field that opens a quote and does not close it matches neither; a quote within an unquoted field
    is a character like any other.
    """
    s = re.escape(sep)
    field = f'(?:"(?:[^"]++|"")*+"[^{s}]*+|[^"{s}][^{s}]*+|)'
    more = f"(?:{s}{field})*+"
    return re.compile(f"[^{s}]*+{more}", re.DOTALL), re.compile(f"{field}{more}", re.DOTALL)


class Scanner:
    """The state after a line, from the state before it: 0 between records, 1 inside quotes."""

    def __init__(self, sep: str):
        self.rest, self.fields = _fields(sep)

    def after(self, state: int, line: str) -> int:
        if QUOTE not in line:
            return state
        if state == 0:
            return 0 if self.fields.fullmatch(line) else 1
        closed = _INSIDE.match(line)
        if closed is None:
            return 1
        return 0 if self.rest.fullmatch(line, closed.end()) else 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order within each split, with the place of their split."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value")
    )


def split_states(lines: DataFrame, sep: str) -> DataFrame:
    """(file, start, before, after): the state in which each split begins and ends, one row a split."""

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, place, ends = Scanner(sep), None, (0, 1)
        out: list[tuple] = []
        for batch in batches:
            for file, start, value in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value"))):
                if (file, start) != place:
                    if place:
                        out.append((*place, *ends))
                    place, ends = (file, start), (0, 1)
                    value = value.removeprefix(BOM) if start == 0 else value
                ends = (scan.after(ends[0], value), scan.after(ends[1], value))
        if place:
            out.append((*place, *ends))
        columns = list(zip(*out)) if out else [(), (), (), ()]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "f0", "f1"])

    quoted = lines.filter(F.contains("value", F.lit(QUOTE)))
    functions = quoted.mapInArrow(composed, "file string, start long, f0 int, f1 int")
    splits = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("_lines"))
    # a split without a quote keeps the state it is given
    known = splits.join(functions, ["file", "start"], "left").select(
        "file", "start", F.coalesce("f0", F.lit(0)).alias("f0"), F.coalesce("f1", F.lit(1)).alias("f1")
    )
    # Two states allow four functions: keep, swap, always 0, always 1. What holds before a split is the
    # outcome of the last constant one, swapped as often as swaps follow it.
    here = Window.partitionBy("file").orderBy("start")
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum(F.when(F.col("f0") > F.col("f1"), 1).otherwise(0))
    fixed = F.when(F.col("f0") == F.col("f1"), F.struct(F.col("f0").alias("s"), F.col("_upto").alias("n")))
    known = known.withColumn("_upto", swaps.over(here)).withColumn("_swaps", F.coalesce(swaps.over(earlier), F.lit(0)))
    known = known.withColumn("_last", F.last(fixed, ignorenulls=True).over(earlier))
    before = F.coalesce(F.col("_last.s") + F.col("_swaps") - F.col("_last.n"), F.col("_swaps")) % 2
    known = known.withColumn("before", before.cast("int"))
    return known.select("file", "start", "before", F.when(F.col("before") == 0, F.col("f0")).otherwise(F.col("f1")).alias("after"))


def _cut(sep: str):
    """Lines with the state their split begins in, as records and pieces of records."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, place, state, held, opens, number = Scanner(sep), None, 0, [], False, 0
        for batch in batches:
            out: list[tuple] = []
            for file, start, before, value in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "before", "value"))):
                if (file, start) != place:
                    if held:
                        out.append((*place, number, PIECE, opens, "\n".join(held)))
                    place, state, held, opens, number = (file, start), before, [], before == 0, 0
                    value = value.removeprefix(BOM) if start == 0 else value
                held.append(value)
                state = scan.after(state, value)
                if state == 0:
                    if held not in ([""], ["\r"]) or not opens:
                        out.append((*place, number, WHOLE if opens else PIECE, opens, "\n".join(held)))
                        number += 1
                    held, opens = [], True
            yield _batch(out)
        if held:
            yield _batch([(*place, number, PIECE, opens, "\n".join(held))])

    return cut


def _batch(rows: Sequence[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "number", "kind", "opens", "record"])


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(first, record): every record of the files as one text; ``first`` marks the first of its file.

    Empty lines between records are left out. A quote that opens a field and is not closed reaches to
    the end of its file. The states of the splits are worked out at once.
    """
    lines = _lines(spark, path)
    states = cut_lineage(split_states(lines, sep))
    # one row for each split, so the broadcast is bounded by the number of tasks
    found = lines.join(F.broadcast(states.drop("after")), ["file", "start"]).select("file", "start", "before", "value")
    whole = found.mapInArrow(_cut(sep), RECORDS).filter(F.col("kind") == WHOLE)
    every = whole.select(((F.col("start") == 0) & (F.col("number") == 0)).alias("first"), "record")
    across = states.filter("before = 1 or after = 1").select("file", "start")
    if not across.isEmpty():
        pieces = found.join(F.broadcast(across), ["file", "start"], "left_semi").mapInArrow(_cut(sep), RECORDS)
        running = Window.partitionBy("file").orderBy("start", "number")
        owned = pieces.filter(F.col("kind") == PIECE).withColumn("owner", F.sum(F.col("opens").cast("int")).over(running))
        parts = F.array_sort(F.collect_list(F.struct("start", "number", "record")))
        mended = owned.groupBy("file", "owner").agg(parts.alias("parts")).select(
            ((F.col("parts")[0]["start"] == 0) & (F.col("parts")[0]["number"] == 0)).alias("first"),
            F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"),
        )
        every = every.unionByName(mended)
    return every.withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def read_records(spark: SparkSession, path: str, header: Sequence[str], sep: str) -> DataFrame:
    """The fields of all records as text, in columns named by ``header``; a file with another header raises."""
    options = {"sep": sep, "quote": QUOTE, "escape": QUOTE, "mode": "FAILFAST", "nullValue": "", "emptyValue": "", "multiLine": "true"}
    places = [f"c{i}" for i in range(len(header))]
    fields = F.from_csv("record", ", ".join(f"{p} string" for p in places), options)
    rows = records(spark, path, sep).select("first", F.col("record"), fields.alias("f"))
    # names that the header reader made up for empty or repeated ones are not compared
    given = [(p, h) for i, (p, h) in enumerate(zip(places, header)) if h != f"_c{i}" and not h.endswith(str(i))]
    same = reduce(lambda a, b: a & b, [F.col(f"f.{p}").eqNullSafe(F.lit(h)) for p, h in given], F.lit(True))
    wrong = F.raise_error(F.concat(F.lit(f"a file does not have the header {list(header)}: "), "record")).cast("boolean")
    body = rows.filter(F.when(~F.col("first"), True).otherwise(F.when(same, False).otherwise(wrong)))
    return body.select(*[F.col(f"f.{p}").alias(h) for p, h in zip(places, header)])
