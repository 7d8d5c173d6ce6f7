"""From raw sentences to agreed labels: clean, export reviews, spread labels, measure agreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.labels import CLASSES, numeric
from labelloom.functions.schema import drop_stale_labels, normalize_header, require_columns, with_known
from labelloom.functions.text import clean_text
from labelloom.functions.votes import row_vote
from labelloom.operators.agreement import agreement_summary
from labelloom.operators.distribution import label_distribution
from labelloom.operators.reviews import (
    REVIEW_KEY,
    assemble_reviews,
    attach_by_ordinal,
    review_agreement,
    spread_labels,
    with_label,
)
from labelloom.session import scratch_path
from labelloom.sources.sinks import write_csv, write_review_blocks

# Label columns and the names of the two compared rater sets.
MANUAL = "label_m"
SENTENCE_RATERS = ("label_m", "label_perplexity", "label_copilot")
REVIEW_RATERS = ("label_chatgpt_review", "label_perplexity_review", "label_copilot_review")
AI_ONLY = "AI chatbots only"
MANUAL_AND_AI = "Manual review label + AI chatbots"


def clean_training_corpus(df: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Clean text and keep rows with a label of the closed class list."""
    df = require_columns(normalize_header(df), ["text", "label"])
    labelled = (
        df.withColumn("label", numeric("label"))
        .filter(F.col("label").isin(*[float(k) for k in classes]))
        .withColumn("label", F.col("label").cast("int"))
    )
    return with_known(labelled, "text", clean_text("text"))


def clean_sentences(df: DataFrame, raters: Sequence[str] = SENTENCE_RATERS) -> DataFrame:
    """Clean text and merge the sentence-level raters (two agree, else the median)."""
    df = require_columns(normalize_header(df, lower=False), ["text", *raters])
    voted = df.withColumn("label", row_vote(raters, tie="median")).filter(F.col("label").isNotNull())
    return with_known(voted, "text", clean_text("text"))


def export_reviews(sentences: DataFrame, table_path: str, blocks_path: str) -> DataFrame:
    """Write the reviews as a table and as text blocks; returns them (see ``assemble_reviews``).

    The reviews are assembled once, into a scratch table that both exports read.
    """
    require_columns(sentences, [*REVIEW_KEY, "sentence_id", "text", MANUAL])
    spark = sentences.sparkSession
    scratch = scratch_path(spark, "reviews")
    assemble_reviews(sentences).write.parquet(scratch)
    reviews = spark.read.parquet(scratch)
    write_csv(reviews.repartitionByRange("review_order").sortWithinPartitions("review_order"), table_path)
    write_review_blocks(reviews, blocks_path)
    return reviews


def label_reviews(reviews: DataFrame, label_files: Mapping[str, DataFrame], ordinal: str = "review_order") -> DataFrame:
    """Attach each rater's ordinal labels; ``label_files`` maps a column to (ordinal, label)."""
    return reduce(
        lambda df, item: attach_by_ordinal(df, item[1].withColumnRenamed("label", item[0]), ordinal),
        label_files.items(),
        reviews,
    )


def distribute_labels(
    sentences: DataFrame,
    reviews: DataFrame,
    raters: Sequence[str] = REVIEW_RATERS,
    key: Sequence[str] = REVIEW_KEY,
    tie: str = "priority",
    check_unique: bool = True,
) -> DataFrame:
    """Sentences with their review's labels and a merged ``label``; earlier labels are replaced.

    Stateless apart from the join, so it also runs on a stream of sentences.
    """
    fresh = drop_stale_labels(sentences)
    joined = spread_labels(fresh, reviews.select(*key, *raters), key, check_unique)
    return with_label(joined, row_vote([MANUAL, *raters], tie=tie, priority=MANUAL))


def final_labels(sentences: DataFrame, raters: Sequence[str] = REVIEW_RATERS) -> DataFrame:
    """Sentences with ``label_final_after_agreement`` and ``label`` set to it."""
    final = row_vote([MANUAL, *raters], tie="priority", priority=MANUAL)
    return with_label(sentences.withColumn("label_final_after_agreement", final), "label_final_after_agreement")


def measure_agreement(sentences: DataFrame, raters: Sequence[str] = REVIEW_RATERS) -> DataFrame:
    """Kappa of the raters alone and together with the manual review vote."""
    reviews = review_agreement(sentences, raters)
    return agreement_summary(
        reviews, {AI_ONLY: list(raters), MANUAL_AND_AI: [f"{MANUAL}_review", *raters]}
    )


def final_distribution(sentences: DataFrame, raters: Sequence[str] = REVIEW_RATERS) -> DataFrame:
    """(label, count) of the final sentence labels, every class listed."""
    return label_distribution(final_labels(sentences, raters))
