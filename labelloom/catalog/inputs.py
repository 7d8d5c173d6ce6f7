"""The given tables in the roles the operators expect, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.sources.tables import read_parquet

RATERS = ["label_chatgpt_review", "label_perplexity_review", "label_copilot_review"]


# tables with much work per row, and the key to deal them out by
DEALT = {"documents": "doc_id", "pages": "page_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows out by ``key`` if fewer tasks than cores would have any.

    A row group is one task's work, however many splits a file is cut into, so the test tables, one row
    group each, keep a single core busy. The count reads footers only, and only of tables with fewer
    files than cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    busy = df.groupBy(F.spark_partition_id().alias("task")).count().count()
    return df if busy >= cores else df.repartition(cores, key)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = read_parquet(spark, folder, name)
    return spread(df, DEALT[name]) if name in DEALT else df


def _rater_columns() -> list:
    base = F.col("review_id") % 3
    second = F.when(F.col("review_id") % 5 == 0, (base + 1) % 3).otherwise(base)
    third = F.when(F.col("review_id") % 4 == 0, (base + 2) % 3).otherwise(base)
    return [c.cast("int").alias(n) for c, n in zip((base, second, third), RATERS, strict=True)]


def bare_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as sentences with a manual label that is sometimes missing."""
    n = F.length("text")
    return table(spark, folder, "conversations").select(
        F.col("role").alias("title"),
        F.col("conv_id").alias("review_id"),
        F.col("turn").alias("sentence_id"),
        "text",
        F.when(n % 7 != 0, n % 3).alias("label_m"),
    )


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences that already carry the labels of three review raters."""
    return bare_sentences(spark, folder).select("*", *_rater_columns())


def review_labels(spark: SparkSession, folder: str) -> DataFrame:
    """One label row per review; reviews whose id is a multiple of 11 were not labelled."""
    keys = table(spark, folder, "conversations").select(
        F.col("role").alias("title"), F.col("conv_id").alias("review_id")
    )
    return keys.distinct().filter("review_id % 11 <> 0").select("*", *_rater_columns())


def classified(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents: (doc_id, text, lang, source, n_chars, label, prediction)."""
    label = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    n = F.col("n_chars")
    return (
        docs.withColumn("label", label)
        .withColumn(
            "prediction",
            F.when(n % 5 == 0, (F.col("label") + 1) % 3).when(n % 7 == 0, (F.col("label") + 2) % 3).otherwise(F.col("label")),
        )
        .select("doc_id", "text", "lang", "source", "n_chars", "label", "prediction")
    )


SQL_RATERS = """
  CAST(review_id % 3 AS INTEGER) AS label_chatgpt_review,
  CAST(CASE WHEN review_id % 5 = 0 THEN (review_id % 3 + 1) % 3 ELSE review_id % 3 END AS INTEGER) AS label_perplexity_review,
  CAST(CASE WHEN review_id % 4 = 0 THEN (review_id % 3 + 2) % 3 ELSE review_id % 3 END AS INTEGER) AS label_copilot_review
"""

SQL_SENTENCES = f"""
bare AS (
  SELECT role AS title, conv_id AS review_id, turn AS sentence_id, text,
         CAST(CASE WHEN length(text) % 7 <> 0 THEN length(text) % 3 END AS INTEGER) AS label_m
  FROM conversations
),
sent AS (SELECT *, {SQL_RATERS} FROM bare),
review_labels AS (
  SELECT *, {SQL_RATERS} FROM (SELECT DISTINCT title, review_id FROM bare) WHERE review_id % 11 <> 0
)
"""

SQL_CLASSIFIED = """
lab AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         CASE WHEN l.quality = 0 THEN 0 WHEN l.toxic = 1 THEN 1 ELSE 2 END AS label
  FROM documents d JOIN labels l USING (doc_id)
),
cls AS (
  SELECT *, CAST(CASE WHEN n_chars % 5 = 0 THEN (label + 1) % 3
                      WHEN n_chars % 7 = 0 THEN (label + 2) % 3 ELSE label END AS INTEGER) AS prediction
  FROM lab
)
"""
