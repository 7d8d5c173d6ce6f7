"""Evaluation of predictions.

One partial aggregation turns any number of predictions into a (true, predicted, count) cell per
pair of classes and data set. Metrics are further aggregates over those cells: no second scan of
the predictions. Only the confusion matrix lists all classes beside each class, to fill its zero cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "f1")


def _cells(df: DataFrame, true: str, pred: str, dataset: str | None) -> DataFrame:
    """(dataset, t, p, n): counted class pairs without a null."""
    name = F.col(dataset) if dataset else F.lit("all")
    t, p = F.col(true), F.col(pred)
    # Rows with a null are left out by their count. A filter on the rows would be pushed below the
    # model and make it score every row twice.
    counted = df.groupBy(name.alias("dataset"), t.alias("t"), p.alias("p")).agg(
        F.count(F.when(t.isNotNull() & p.isNotNull(), 1)).alias("n")
    )
    return counted.filter("n > 0")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def confusion_matrix(df: DataFrame, true: str, pred: str, dataset: str | None = None) -> DataFrame:
    """(dataset, true_label, predicted_label, count) with zero cells, labels from either column."""
    # every cell goes to its true class; its predicted class is made known without a count
    cell = F.struct(F.col("p").alias("predicted_label"), F.col("n").alias("count"))
    sides = F.array(
        F.struct(F.col("t").alias("true_label"), cell.alias("cell")),
        F.struct(F.col("p").alias("true_label"), F.lit(None).alias("cell")),
    )
    by_class = (
        _cells(df, true, pred, dataset)
        .select("dataset", F.inline(sides))
        .groupBy("dataset", "true_label")
        .agg(F.collect_list("cell").alias("cells"))
    )
    labels = F.collect_list("true_label").over(Window.partitionBy("dataset"))
    zeros = F.transform("labels", lambda p: F.struct(p.alias("predicted_label"), F.lit(0).cast("long").alias("count")))
    return (
        by_class.withColumn("labels", labels)
        .select("dataset", "true_label", F.inline(F.concat(zeros, "cells")))
        .groupBy("dataset", "true_label", "predicted_label")
        .agg(F.sum("count").alias("count"))
    )


def _per_class(df: DataFrame, true: str, pred: str, dataset: str | None) -> DataFrame:
    """(dataset, class, hit, support, precision, recall, f1), a row per class."""
    n, zero = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("t") == F.col("p"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("t").alias("class"), hit.alias("hit"), n.alias("support"), zero.alias("predicted")),
        F.struct(F.col("p").alias("class"), zero.alias("hit"), zero.alias("support"), n.alias("predicted")),
    )
    totals = (
        _cells(df, true, pred, dataset)
        .select("dataset", F.inline(sides))
        .groupBy("dataset", "class")
        .agg(*[F.sum(c).alias(c) for c in ("hit", "support", "predicted")])
    )
    return totals.select(
        "dataset",
        "class",
        "hit",
        "support",
        _ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def _averages() -> list[Column]:
    """Aggregates over rows of ``_per_class``; a class that is only predicted has no share of its own."""
    rows = F.sum("support")
    return [
        rows.alias("rows"),
        F.try_divide(F.sum("hit"), rows).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in METRICS],
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), rows).alias(f"weighted_{m}") for m in METRICS],
    ]


def scores(df: DataFrame, true: str, pred: str, dataset: str | None = None) -> DataFrame:
    """One row per data set: accuracy, macro and weighted precision, recall and F1, row count."""
    out = _per_class(df, true, pred, dataset).groupBy("dataset").agg(*_averages())
    averages = [f"{kind}_{m}" for kind in ("macro", "weighted") for m in METRICS]
    return out.select("dataset", F.col("rows").alias("support"), "accuracy", *averages)


def classification_report(df: DataFrame, true: str, pred: str, dataset: str | None = None) -> DataFrame:
    """(dataset, class, precision, recall, f1, support): a row per class, and accuracy, macro avg
    and weighted avg (accuracy stands in the f1 column, as in the printed report)."""
    # each class counts for its own line and, under no class, for the whole data set
    per = _per_class(df, true, pred, dataset)
    none = F.lit(None).cast(per.schema["class"].dataType)
    both = per.select("*", F.explode(F.array(F.col("class"), none)).alias("line"))
    lines = both.groupBy("dataset", "line").agg(*_averages())

    def line(name: Column, p: Column, r: Column, f: Column) -> Column:
        return F.struct(
            name.alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("rows").alias("support")
        )

    null = F.lit(None).cast("double")
    macro, weighted = ([F.col(f"{kind}_{m}") for m in METRICS] for kind in ("macro", "weighted"))
    totals = F.array(
        line(F.lit("accuracy"), null, null, F.col("accuracy")),
        line(F.lit("macro avg"), *macro),
        line(F.lit("weighted avg"), *weighted),
    )
    own = F.array(line(F.col("line").cast("string"), *macro))
    return lines.select("dataset", F.inline(F.when(F.col("line").isNull(), totals).otherwise(own)))


def metric_table(df: DataFrame, true: str, pred: str, dataset: str | None = None) -> DataFrame:
    """(dataset, metric, class, value): the report as one row per number, for a report sink."""
    report = classification_report(df, true, pred, dataset)
    values = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("precision", "recall", "f1", "support")]
    )
    return (
        report.select("dataset", "class", F.explode(values).alias("v"))
        .select("dataset", F.col("v.metric").alias("metric"), "class", F.col("v.value").alias("value"))
        .filter(F.col("value").isNotNull())
    )


def accuracy(df: DataFrame, true: str, pred: str, dataset: str | None = None) -> DataFrame:
    """(dataset, accuracy), counted directly."""
    name = F.col(dataset) if dataset else F.lit("all")
    known = df.filter(F.col(true).isNotNull() & F.col(pred).isNotNull())
    return known.groupBy(name.alias("dataset")).agg(
        (F.count_if(F.col(true) == F.col(pred)) / F.count(F.lit(1))).alias("accuracy")
    )


def fold_summary(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of the fold scores."""
    return df.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def prediction_table(df: DataFrame, text: str, true: str, pred: str, correct: bool = False) -> DataFrame:
    """(text, prediction_label, truth_label), or with ``correct`` (text, true_label,
    predicted_label, correct)."""
    if correct:
        return df.select(
            F.col(text).alias("text"),
            F.col(true).alias("true_label"),
            F.col(pred).alias("predicted_label"),
            (F.col(true) == F.col(pred)).alias("correct"),
        )
    return df.select(
        F.col(text).alias("text"), F.col(pred).alias("prediction_label"), F.col(true).alias("truth_label")
    )


def best_run(results: DataFrame, score: str, order: str) -> DataFrame:
    """The row with the highest score; the earliest by ``order`` wins a tie."""
    rest = [c for c in results.columns]
    # nulls never win; the order is negated by taking the smallest among the best
    best = results.filter(F.col(score).isNotNull()).agg(
        F.min_by(F.struct(*rest), F.struct(-F.col(score), F.col(order))).alias("_b")
    )
    return best.filter(F.col("_b").isNotNull()).select("_b.*")
