"""Sentences and reviews: assembling, agreement tables and label joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.labels import int_label
from labelloom.functions.schema import drop_null_keys
from labelloom.functions.text import has_text, strip
from labelloom.functions.votes import vote_by_group, winner
from labelloom.operators.ordinal import global_ordinal

REVIEW_KEY = ("title", "review_id")

# The layout of one block in the text export.
RULE = "=" * 80


def _in_order(order: str, text: Column) -> Column:
    """Aggregate: the texts of a group joined with blanks, by ``order``, those without one last."""
    items = F.collect_list(F.struct(F.col(order).isNull().alias("z"), F.col(order).alias("o"), text.alias("t")))
    return F.array_join(F.transform(F.array_sort(items), lambda s: s["t"]), " ")


def assemble_reviews(
    sentences: DataFrame,
    key: Sequence[str] = REVIEW_KEY,
    order: str = "sentence_id",
    text: str = "text",
    manual: str = "label_m",
    span: int = 4096,
) -> DataFrame:
    """One row per review: its whole text, joined with blanks in sentence order.

    Sentences without a number stand last and do not count; ``review_order`` numbers the reviews
    1..n in key order. Sentences are first joined by blocks of ``span`` numbers, in parallel for one
    huge review, and the ordered blocks then make one row; ``span`` does not change the result. The
    numbering works on a narrow table of keys and votes.
    """
    key = list(key)
    rows = drop_null_keys(sentences, key).filter(has_text(text))
    block = F.floor(F.col(order) / span).alias("_block")
    pieces = rows.groupBy(*key, block).agg(F.count(order).alias("_n"), _in_order(order, strip(text)).alias("_piece"))
    texts = pieces.groupBy(*key).agg(
        F.sum("_n").alias("number_of_sentences"), _in_order("_block", F.col("_piece")).alias("full_review")
    )
    votes = global_ordinal(vote_by_group(rows, key, manual, order, "label_m_review"), key, "review_order")
    return texts.join(votes, key).select("review_order", *key, "full_review", "number_of_sentences", "label_m_review")


def review_blocks(reviews: DataFrame, key: Sequence[str] = REVIEW_KEY) -> DataFrame:
    """The record-block text of each review, without its last line end, which the text writer adds."""
    title, review_id = key
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("REVIEW_ORDER: "), F.col("review_order").cast("string")),
        F.concat(F.lit("TITLE: "), F.col(title).cast("string")),
        F.concat(F.lit("REVIEW_ID: "), F.col(review_id).cast("string")),
        F.concat(F.lit("NUMBER_OF_SENTENCES: "), F.col("number_of_sentences").cast("string")),
        F.lit("FULL_REVIEW:"),
        F.col("full_review"),
        F.lit(f"{RULE}\n"),
    )
    return reviews.select("review_order", block.alias("block"))


def review_agreement(
    sentences: DataFrame,
    raters: Sequence[str],
    key: Sequence[str] = REVIEW_KEY,
    order: str = "sentence_id",
    manual: str = "label_m",
) -> DataFrame:
    """One row per review: manual vote, the first known label of each rater, sentence count.

    Tallies by (review, manual label) in one scan, then one row per review from the tallies. Both
    combine on the map side; a review with a third of all rows is safe.
    """
    key = list(key)
    rows = drop_null_keys(sentences, key).withColumn("_vote", int_label(manual))
    at = {r: F.when(F.col(r).isNotNull(), F.col(order)) for r in raters}
    firsts = [c for r in raters for c in (F.min_by(r, at[r]).alias(r), F.min(at[r]).alias(f"_at_{r}"))]
    tallies = rows.groupBy(*key, "_vote").agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"), F.count(order).alias("_numbered"), *firsts
    )
    return tallies.groupBy(*key).agg(
        winner(F.col("_vote"), F.col("_n"), F.col("_first")).alias(f"{manual}_review"),
        *[F.min_by(r, f"_at_{r}").alias(r) for r in raters],
        F.sum("_numbered").alias("number_of_sentences"),
    )


def distinct_reviews(sentences: DataFrame, key: Sequence[str] = REVIEW_KEY) -> DataFrame:
    """The distinct, complete review keys."""
    return drop_null_keys(sentences, key).select(*key).distinct()


def reviews_in_appearance_order(
    sentences: DataFrame, position: Sequence[str], key: Sequence[str] = REVIEW_KEY
) -> DataFrame:
    """Review keys numbered 1..n by their first row in the explicit ``position`` order."""
    first = (
        drop_null_keys(sentences, key)
        .groupBy(*key)
        .agg(F.min(F.struct(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(position)])).alias("_first"))
    )
    spread = [f"_first._p{i}" for i in range(len(position))]
    flat = first.select(*key, *[F.col(s).alias(f"_p{i}") for i, s in enumerate(spread)])
    order = [f"_p{i}" for i in range(len(position))]
    return global_ordinal(flat, [*order, *key], "review_order").drop(*order)


def attach_by_ordinal(reviews: DataFrame, labels: DataFrame, ordinal: str, strict: bool = True) -> DataFrame:
    """The n-th label belongs to the n-th review.

    ``strict`` raises when the counts differ; otherwise reviews without a label and labels without a
    review stay, with nulls for what they lack.
    """
    if strict:
        counts = label_cardinality(reviews, labels).first()
        if not counts["matches"]:
            raise ValueError(f"{counts['labels']} labels for {counts['reviews']} reviews")
    return reviews.join(labels, ordinal, "inner" if strict else "full")


def label_cardinality(reviews: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: how many reviews, how many labels, and whether the counts match."""
    sides = reviews.select(F.lit(1).alias("r"), F.lit(0).alias("l")).unionAll(
        labels.select(F.lit(0).alias("r"), F.lit(1).alias("l"))
    )
    counts = sides.agg(
        F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("reviews"),
        F.coalesce(F.sum("l"), F.lit(0)).cast("long").alias("labels"),
    )
    return counts.select("reviews", "labels", (F.col("reviews") == F.col("labels")).alias("matches"))


def spread_labels(
    sentences: DataFrame, reviews: DataFrame, key: Sequence[str] = REVIEW_KEY, check_unique: bool = True
) -> DataFrame:
    """Give every sentence the labels of its review; sentences without one keep null labels.

    One join without a hint: the review table grows with the data, so Spark picks the join from
    run-time sizes and splits the sentences of a hot review over tasks. That no key has two label rows
    is asserted in the plan, by an aggregate on the join key: nothing runs before the action does.
    """
    reviews = drop_null_keys(reviews, key)
    return sentences.join(_unique(reviews, key) if check_unique else reviews, list(key), "left")


def _unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df``, whose evaluation fails if rows share a key. One exchange by key serves the join, too."""
    rest = [c for c in df.columns if c not in key]
    row = F.any_value(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_row") if rest else F.lit(None).alias("_row")
    grouped = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), row)
    said = F.concat(F.lit(f"several label rows share one {tuple(key)}: "), F.to_json(F.struct(*key)))
    checked = grouped.filter(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(said).cast("boolean")))
    return checked.select(*[c if c in key else F.col("_row").getField(c).alias(c) for c in df.columns])


def unmatched(sentences: DataFrame, reviews: DataFrame, key: Sequence[str] = REVIEW_KEY) -> DataFrame:
    """Sentences whose review has no label row."""
    return sentences.join(drop_null_keys(reviews, key).select(*key), list(key), "left_anti")


def unmatched_count(sentences: DataFrame, reviews: DataFrame, key: Sequence[str] = REVIEW_KEY) -> DataFrame:
    """One row with the number of sentences that have no review label."""
    return unmatched(sentences, reviews, key).agg(F.count(F.lit(1)).alias("unmatched"))


def with_label(df: DataFrame, label: Column | str, name: str = "label") -> DataFrame:
    """Derive (or overwrite) a label column."""
    return df.withColumn(name, F.col(label) if isinstance(label, str) else label)
