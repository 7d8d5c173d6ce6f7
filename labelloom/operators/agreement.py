"""Rating matrix and Fleiss' kappa.

All sums are over integers until the last step, so the result does not depend on how rows were
spread over tasks. One scan serves any number of rater sets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.labels import int_label, interpret_kappa
from labelloom.functions.schema import require_columns, require_rows


def complete_ratings(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Rows that every rater has labelled with a number; a label that cannot be read is none."""
    return require_columns(df, raters).filter(reduce(lambda a, b: a & b, [int_label(r).isNotNull() for r in raters]))


def rating_matrix(df: DataFrame, item: Sequence[str], raters: Sequence[str]) -> DataFrame:
    """(item, category, votes): how many raters put the item into the category."""
    ratings = F.explode(F.array(*[int_label(r) for r in raters])).alias("category")
    return (
        complete_ratings(df, raters)
        .select(*item, ratings)
        .groupBy(*item, "category")
        .agg(F.count(F.lit(1)).alias("votes"))
    )


def fleiss_kappa(df: DataFrame, rater_sets: Mapping[str, Sequence[str]], strict: bool = False) -> DataFrame:
    """(comparison, samples, categories, kappa, interpretation) for each named set of raters.

    Each row must be one item. The agreement of an item is the number of equal ordered rater
    pairs (itself included), which needs no list of categories. Kappa is null where chance
    agreement is total. A set without complete rows gives no row, or an error if ``strict``.
    """
    if strict:
        for raters in rater_sets.values():
            require_rows(complete_ratings(df, raters), f"ratings by {list(raters)}")
    packed = []
    for name, raters in rater_sets.items():
        require_columns(df, raters)
        votes = [int_label(r) for r in raters]
        pairs = reduce(
            lambda a, b: a + b,
            [F.when(a == b, F.lit(1)).otherwise(F.lit(0)) for a in votes for b in votes],
        )
        known = reduce(lambda a, b: a & b, [v.isNotNull() for v in votes])
        packed.append(
            F.when(
                known,
                F.struct(
                    F.lit(name).alias("comparison"),
                    F.lit(len(raters)).cast("long").alias("r"),
                    pairs.cast("long").alias("pairs"),
                    F.array(*votes).alias("votes"),
                ),
            )
        )
    sets = df.select(F.explode(F.array_compact(F.array(*packed))).alias("s")).select("s.*")
    # every vote carries its item's pair count, so the sums are r times too large
    by_category = (
        sets.select("comparison", "r", "pairs", F.explode("votes").alias("category"))
        .groupBy("comparison", "r", "category")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("pairs").alias("pairs"))
    )
    total = by_category.groupBy("comparison", "r").agg(
        F.sum("n").alias("votes"),
        F.sum("pairs").alias("pairs"),
        F.sum(F.col("n").cast("decimal(38,0)") * F.col("n")).alias("squares"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    )
    samples = F.col("votes") / F.col("r")
    observed = (F.col("pairs") / F.col("r") / samples - F.col("r")) / (F.col("r") * (F.col("r") - 1))
    chance = F.col("squares").cast("double") / F.col("votes") / F.col("votes")
    kappa = (F.col("observed") - F.col("chance")) / F.nullif(1 - F.col("chance"), F.lit(0.0))
    return (
        total.select(
            "comparison",
            samples.cast("long").alias("samples"),
            "categories",
            observed.alias("observed"),
            chance.alias("chance"),
        )
        .withColumn("kappa", kappa)
        .withColumn("interpretation", interpret_kappa("kappa"))
    )


def agreement_summary(df: DataFrame, rater_sets: Mapping[str, Sequence[str]], level: str = "review") -> DataFrame:
    """(comparison, level, samples, kappa rounded to 4 places, interpretation)."""
    return fleiss_kappa(df, rater_sets).select(
        "comparison",
        F.lit(level).alias("level"),
        "samples",
        F.round("kappa", 4).alias("kappa"),
        "interpretation",
    )
