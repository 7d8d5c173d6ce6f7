"""Counts, class distributions and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.labels import CLASSES
from labelloom.operators.bounded import join_small


def label_distribution(df: DataFrame, label: str = "label", classes: Sequence[int] | None = CLASSES) -> DataFrame:
    """(label, count), null labels left out; with ``classes`` a class without rows counts 0."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    if classes is None:
        return counts
    # one zero row per listed class joins the counting, so no second pass is needed
    zeros = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in classes])).alias("label"), F.lit(0).cast("long").alias("count"))
    return counts.unionByName(zeros).groupBy("label").agg(F.sum("count").alias("count"))


def row_counts(df: DataFrame, name: str) -> DataFrame:
    """(name, rows)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, count, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    # one row: all classes and all their rows, added up from the counts
    whole = counts.agg(F.struct(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.select(label, "count", whole.alias("_w")).select(
        F.col(label), "count", (F.col("_w.rows") / (F.col("_w.k") * F.col("count"))).alias("weight")
    )


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Attach the balanced weight of its class to each row, without shuffling the rows."""
    return join_small(df, class_weights(df, label).select(label, "weight"), [label])
