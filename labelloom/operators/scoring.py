"""Batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType, ArrayType

from labelloom.functions.labels import argmax

Predict = Callable[[pd.DataFrame], "pd.Series | list"]


def linear_scores(features: str, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """Class scores of a linear model over an array column, one dot product per class."""
    bias = bias or [0.0] * len(weights)
    out = []
    for row, b in zip(weights, bias, strict=True):
        w = F.array(*[F.lit(float(v)) for v in row])
        products = F.zip_with(F.col(features), w, lambda x, y: x.cast("double") * y)
        out.append(F.aggregate(products, F.lit(float(b)), lambda acc, v: acc + v))
    return F.array(*out)


def predict_linear(
    df: DataFrame, features: str, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None, name: str = "prediction"
) -> DataFrame:
    """Arg-max class of a linear model, inside the JVM."""
    return df.withColumn(name, argmax(linear_scores(features, weights, bias)))


def score_batches(
    df: DataFrame,
    load: Callable[[], Predict],
    columns: Sequence[str],
    keep: Sequence[str],
    name: str = "scores",
) -> DataFrame:
    """Class scores from any Python model, by Arrow batches, plus their arg-max ``prediction``.

    ``load`` runs once per task and returns a function from a batch (with ``columns``) to one
    list of class scores per row. ``keep`` names the columns passed through.
    """
    needed = list(dict.fromkeys([*keep, *columns]))
    schema = StructType([df.schema[c] for c in keep] + [StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            out = batch[list(keep)].copy()
            out[name] = list(predict(batch[list(columns)]))
            yield out

    return df.select(*needed).mapInPandas(run, schema).withColumn("prediction", argmax(name))
