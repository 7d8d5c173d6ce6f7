"""The text export from sentence rows: no review has to fit in a cell.

Sentences are range-sorted over all tasks and every row carries what stands beside it: the first one of
a review its header, the last one the rule and the beginning of the next header. What is left between
two rows is one blank, everywhere, which is the line separator of the writer: sentences are parted by a
blank, and so are "REVIEW_ORDER:" and the number of the next review.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.schema import drop_null_keys
from labelloom.functions.text import has_text, strip
from labelloom.operators.ordinal import global_ordinal
from labelloom.operators.reviews import REVIEW_KEY, RULE
from labelloom.session import cut_lineage

BODY, END = "0-reviews", "1-end"
_HEAD = "REVIEW_ORDER:"


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their separators; ``closing`` marks the last row of the export."""
    last, held = None, None
    fresh = True

    def text(row: dict, following: int | None) -> str:
        nonlocal last, fresh
        if fresh:
            last, fresh = row["lower"], False
        own = row["body"]
        if last != row["review_order"]:
            head = f"{row['review_order']}\nTITLE: {row['title']}\nREVIEW_ID: {row['review_id']}\nNUMBER_OF_SENTENCES: {row['number_of_sentences']}\nFULL_REVIEW:\n"
            own = (f"{_HEAD} " if last is None else "") + head + own
        if following is None:
            own += f"\n{RULE}\n"
        elif following != row["review_order"]:
            own += f"\n{RULE}\n\n{_HEAD}"
        last = row["review_order"]
        return own

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held is not None:
                out.append(text(held, row["review_order"]))
            held = row
        yield pa.record_batch([pa.array(out, pa.string()), pa.array([False] * len(out), pa.bool_())], ["value", "closing"])
    if held is not None:
        closing = held["upper"] is None
        yield pa.record_batch([pa.array([text(held, held["upper"])], pa.string()), pa.array([closing], pa.bool_())], ["value", "closing"])


def compose(sentences: DataFrame, key: Sequence[str] = REVIEW_KEY, order: str = "sentence_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, end): the export as rows in order, to be parted by blanks, and its last row apart.

    The same reviews in the same order as ``assemble_reviews``. Only keys and counts are grouped; the
    sentences are joined with them, sorted once and fixed by a checkpoint.
    """
    title, review_id = key
    known = drop_null_keys(sentences, key).filter(has_text(text))
    counted = known.groupBy(*key).agg(F.count(order).alias("number_of_sentences"))
    reviews = global_ordinal(counted, list(key), "review_order")
    own = known.select(*key, F.col(order).isNull().alias("_late"), F.col(order).alias("_at"), strip(text).alias("body"))
    place = ["review_order", "_late", "_at", "body"]
    ranged = own.join(reviews, list(key)).repartitionByRange(*place).sortWithinPartitions(*place)
    fixed = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    by_part = Window.orderBy("_part")
    spans = fixed.groupBy("_part").agg(F.min("review_order").alias("lo"), F.max("review_order").alias("hi"))
    # one row per shuffle partition: what stands before and after it
    borders = F.broadcast(spans.select("_part", F.lag("hi").over(by_part).alias("lower"), F.lead("lo").over(by_part).alias("upper")))
    beside = fixed.join(borders, "_part").select(
        "review_order",
        F.col(title).cast("string").alias("title"),
        F.col(review_id).cast("string").alias("review_id"),
        "number_of_sentences",
        "body",
        "lower",
        "upper",
    )
    rows = beside.mapInArrow(_composed, "value string, closing boolean")
    end = beside.filter(F.col("upper").isNull()).mapInArrow(_composed, "value string, closing boolean")
    return rows.filter(~F.col("closing")).select("value"), end.filter("closing").select("value")


def write_review_text(
    sentences: DataFrame,
    path: str,
    key: Sequence[str] = REVIEW_KEY,
    order: str = "sentence_id",
    text: str = "text",
    mode: str = "error",
) -> None:
    """The text export of ``write_review_blocks``, straight from the sentences.

    The part files of the folders ``BODY`` and ``END``, read in this order and in name order, are the export.
    """
    rows, end = compose(sentences, key, order, text)
    rows.write.mode(mode).text(f"{path}/{BODY}", lineSep=" ")
    end.write.mode(mode).text(f"{path}/{END}", lineSep="\n")
