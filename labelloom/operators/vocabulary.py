"""Corpus counts, vocabularies and id sequences.

A vocabulary is bounded by its size parameter, so it may be broadcast; the corpus never is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators.bounded import BROADCAST_ROWS
from labelloom.operators.ordinal import global_ordinal
from labelloom.session import settle

# Reserved token ids and the sequence length.
PAD_ID = 0
UNKNOWN_ID = 1
FIRST_ID = 2
SEQUENCE_LENGTH = 100
MAX_TOKENS = 30_000

#: Bits of a frequency that one pass of the selection settles.
RADIX_BITS = 12


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """(token, count) over the corpus; counts combine on the map side."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def _occurrences(df: DataFrame, tokens: Column, doc: str, *more: str) -> tuple[DataFrame, Column]:
    """(doc, more, _i, term) and which rows lead: each document as its distinct terms followed by all its terms.

    Leading rows count documents, the others occurrences, so one aggregate by term yields both.
    """
    own = df.select(doc, *more, tokens.alias("_all")).withColumn("_own", F.array_distinct("_all"))
    # Sized before the explode, so that no array travels with the exploded rows. The explode takes
    # an expression, not a column: on a column Spark would infer a filter and push the whole
    # tokenising into it.
    sized = own.withColumn("_k", F.size("_own"))
    rows = sized.select(doc, *more, "_k", F.posexplode(F.concat("_own", "_all")).alias("_i", "term"))
    return rows, F.col("_i") < F.col("_k")


def term_statistics(df: DataFrame, tokens: Column, doc: str, by: Sequence[str] = ()) -> DataFrame:
    """(term, by, tf, df, first_doc, first_pos): corpus and document frequency, first occurrence.

    Everything combines on the map side, so only one row per task and term is shuffled, never one
    per document and term. ``first_pos`` is the rank among the distinct terms of ``first_doc``,
    which orders like the token position.
    """
    rows, lead = _occurrences(df, tokens, doc, *by)
    return rows.groupBy("term", *by).agg(
        F.count_if(~lead).alias("tf"),
        F.count_if(lead).alias("df"),
        F.min(F.when(lead, F.col(doc))).alias("first_doc"),
        F.min_by("_i", F.when(lead, F.col(doc))).alias("first_pos"),
    )


def fold_statistics(df: DataFrame, tokens: Column, doc: str, folds: int, fold: str = "fold") -> DataFrame:
    """(term, tf, df, tf_0, df_0, tf_1, ...): frequencies in the whole corpus and in each fold, a row a term.

    What a fold learns from is the whole without its own part, a difference within the row.
    """
    rows, lead = _occurrences(df, tokens, doc, fold)
    within = [F.col(fold) == f for f in range(folds)]
    return rows.groupBy("term").agg(
        F.count_if(~lead).alias("tf"),
        F.count_if(lead).alias("df"),
        *[c for f, own in enumerate(within) for c in (F.count_if(~lead & own).alias(f"tf_{f}"), F.count_if(lead & own).alias(f"df_{f}"))],
    )


def without_fold(stats: DataFrame, fold: int) -> DataFrame:
    """(term, tf, df) over all folds but one, from ``fold_statistics``."""
    rest = [(F.col(c) - F.col(f"{c}_{fold}")).alias(c) for c in ("tf", "df")]
    return stats.select("term", *rest).filter("tf > 0")


def _threshold(stats: DataFrame, size: int) -> tuple[int, int, int]:
    """The frequency of the ``size``-th most frequent term, how many terms are more frequent, and how
    many are as frequent. With fewer terms: (0, number of terms, 0).

    Frequencies are narrowed down ``RADIX_BITS`` at a time: each pass counts the terms by the leading
    bits of their frequency, at most ``2 ** RADIX_BITS`` rows, and goes on in the class where ``size``
    is reached. A pass reads one column, and there are as many as the largest frequency has such digits.
    """
    largest, terms = stats.agg(F.max("tf"), F.count(F.lit(1))).first()
    if terms <= size:
        return 0, terms, 0
    shift = -(-largest.bit_length() // RADIX_BITS) * RADIX_BITS
    low, above = 0, 0
    while shift:
        shift -= RADIX_BITS
        inside = stats.filter(F.col("tf").between(low, low + (1 << (shift + RADIX_BITS)) - 1))
        classes = inside.groupBy(F.shiftright(F.col("tf") - low, shift).alias("c")).count().collect()
        for r in sorted(classes, key=lambda r: -r["c"]):
            if above + r["count"] >= size:
                low, equal = low + (r["c"] << shift), r["count"]
                break
            above += r["count"]
    return low, above, equal


def most_frequent(stats: DataFrame, size: int, ties: Sequence[str], written: bool = False) -> DataFrame:
    """The ``size`` rows of ``stats`` with the highest ``tf``, equal ones at the edge in order of ``ties``.

    A threshold on the frequency selects them, so no task ever sees more than its own rows; where the
    edge cuts through equal frequencies, those are numbered by a range sort. ``stats`` is written once,
    unless it only reads from what is ``written`` already.
    """
    stats = stats if written else settle(stats, "terms")
    least, above, equal = _threshold(stats, size)
    if not least or above + equal == size:
        return stats.filter(F.col("tf") >= least)
    edge = global_ordinal(stats.filter(F.col("tf") == least), list(ties), "_place").filter(F.col("_place") <= size - above)
    return stats.filter(F.col("tf") > least).unionByName(edge.drop("_place"))


def top_vocabulary(stats: DataFrame, size: int = MAX_TOKENS) -> DataFrame:
    """(token, id, count): the ``size`` most frequent terms, ties by first occurrence, ids from 2."""
    order = [F.desc("tf"), F.asc("first_doc"), F.asc("first_pos")]
    top = most_frequent(stats.select("term", "tf", "first_doc", "first_pos"), size, ["first_doc", "first_pos"])
    # at most ``size`` rows reach this window
    return top.select(
        F.col("term").alias("token"),
        (F.row_number().over(Window.orderBy(*order)) + (FIRST_ID - 1)).cast("int").alias("id"),
        F.col("tf").alias("count"),
    )


def feature_vocabulary(stats: DataFrame, size: int, min_df: int = 1, written: bool = False) -> DataFrame:
    """(term, idx, tf, df): terms in ``min_df`` documents, the ``size`` most frequent, indexed
    0.. in term order; equal frequencies at the edge are cut in term order. ``written``: ``stats``
    reads from a table or checkpoint."""
    top = most_frequent(stats.select("term", "tf", "df").filter(F.col("df") >= min_df), size, ["term"], written)
    return top.select(
        "term",
        (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("idx"),
        "tf",
        "df",
    )


def _broadcast_vocabulary(vocabulary: DataFrame, size: int) -> DataFrame:
    return F.broadcast(vocabulary) if size <= BROADCAST_ROWS else vocabulary


def lookup(df: DataFrame, tokens: Column, vocabulary: DataFrame, doc: str, size: int = MAX_TOKENS) -> DataFrame:
    """(doc, pos, token, known_id, id): each token with its vocabulary id, unknown ones id 1.

    The vocabulary is broadcast, the tokens are not shuffled.
    """
    words = df.select(doc, F.posexplode(tokens).alias("pos", "token"))
    vocab = _broadcast_vocabulary(vocabulary.select("token", F.col("id").alias("known_id")), size)
    found = words.join(vocab, "token", "left")
    return found.select(doc, "pos", "token", "known_id", F.coalesce("known_id", F.lit(UNKNOWN_ID)).alias("id"))


def encode(
    df: DataFrame,
    tokens: Column,
    vocabulary: DataFrame,
    doc: str,
    length: int = SEQUENCE_LENGTH,
    size: int = MAX_TOKENS,
) -> DataFrame:
    """(doc, ids): token ids, unknown ones 1, cut to ``length`` and right-padded with 0.

    Tokens beyond ``length`` are sliced off before the lookup; ``doc`` must be unique, so a group
    holds at most ``length`` ids. ``size`` bounds the vocabulary.
    """
    words = df.select(doc, F.posexplode_outer(F.slice(tokens, 1, length)).alias("_i", "token"))
    vocab = _broadcast_vocabulary(vocabulary.select("token", "id"), size)
    found = words.join(vocab, "token", "left").select(
        doc,
        F.when(F.col("token").isNotNull(), F.struct("_i", F.coalesce("id", F.lit(UNKNOWN_ID)).alias("id"))).alias("_t"),
    )
    listed = found.groupBy(doc).agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    ids = F.transform("_t", lambda t: t["id"])
    return listed.select(
        doc, F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.lit(length) - F.size("_t"))).alias("ids")
    )
