"""Ordinal label files: one label per line, the n-th non-blank line belongs to the n-th review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.functions.labels import normalize_label
from labelloom.functions.text import strip


def read_label_file(
    spark: SparkSession,
    path: str,
    ordinal: str = "review_order",
    label: str = "label",
    normalize: bool = True,
) -> DataFrame:
    """(ordinal, label) with non-blank lines numbered 1..n in file order.

    The file is read in splits. Lines keep their order inside a split, and a split knows its
    place in the file, so a line's number is its rank in its split plus the lines of the splits
    before it. Neither a whole file nor one window over all lines is needed.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        strip("value").alias("word"),
    )
    lines = lines.filter(F.col("word") != "")
    split = ["_file", "_start"]
    # part files count by their number: part-100000 comes after part-99999
    number = F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1)
    before = Window.orderBy(F.when(number != "", number.cast("decimal(38,0)")), *split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        lines.groupBy(*split)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    place = F.row_number().over(Window.partitionBy(*split).orderBy("_at"))
    value = normalize_label("word") if normalize else F.col("word")
    ranked = lines.withColumn("_place", place)
    return ranked.join(offsets, split).select(
        (F.col("_before") + F.col("_place")).cast("long").alias(ordinal), value.alias(label)
    )
