"""Majority votes with explicit tie rules.

Votes across columns are plain expressions: no explode, no shuffle, no Python. Votes down a
group are built from tallies that combine on the map side, so one huge group costs no more than
its partial counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.labels import NEUTRAL, int_label, numeric
from labelloom.functions.text import bind


def _leaders(votes: Column) -> Column:
    """The labels with most votes in an array without nulls, the one voted for first at the front."""

    def counted(v: Column) -> Column:
        return F.struct(F.size(F.filter(votes, lambda w: w == v)).alias("n"), v.alias("vote"))

    def most(tallies: Column) -> Column:
        best = F.array_max(tallies)["n"]
        return F.transform(F.filter(tallies, lambda t: t["n"] == best), lambda t: t["vote"])

    return bind(F.transform(F.array_distinct(votes), counted), most)


def row_vote(
    columns: Sequence[str],
    tie: str = "neutral",
    priority: str | None = None,
    strict: bool = False,
) -> Column:
    """The most frequent label among ``columns``; null votes are skipped, all null gives null.

    tie="neutral":  a tie that includes the neutral class is neutral, any other tie goes to the
                    tied label that stands first in column order.
    tie="priority": a tie goes to the label in ``priority`` (null there gives null, or an error
                    if ``strict``).
    tie="median":   a label needs two votes; otherwise the median of the votes, truncated.

    Every vote is parsed once, into an array that the rest of the expression works on, so the plan
    grows in proportion to the number of raters.
    """
    if tie == "median":
        return bind(F.array_compact(F.array(*[numeric(c) for c in columns])), _median_vote).cast("int")
    votes = F.array_compact(F.array(*[int_label(c) for c in columns]))
    if tie == "neutral":

        def decide(top: Column) -> Column:
            return F.when(F.array_contains(top, NEUTRAL), F.lit(NEUTRAL)).otherwise(F.get(top, F.lit(0)))

    elif tie == "priority":
        if priority is None:
            raise ValueError("tie='priority' needs the priority column")
        decided = int_label(priority)
        if strict:
            decided = F.coalesce(decided, F.raise_error(F.lit(f"tie without a label in {priority}")).cast("int"))

        def decide(top: Column) -> Column:
            return F.when(F.size(top) > 1, decided).otherwise(F.get(top, F.lit(0)))

    else:
        raise ValueError(f"unknown tie rule: {tie}")
    return bind(votes, lambda known: bind(_leaders(known), decide))


def _median_vote(votes: Column) -> Column:
    n = F.size(votes)

    def middle(ranked: Column) -> Column:
        low = F.get(ranked, F.floor((n - 1) / 2).cast("int"))
        high = F.get(ranked, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2)

    agreed = F.size(F.array_distinct(votes)) < n
    return F.when(agreed, F.get(_leaders(votes), F.lit(0))).otherwise(bind(F.array_sort(votes), middle))


def winner(vote: Column, n: Column, first: Column, neutral: int = NEUTRAL) -> Column:
    """Aggregate over tallies (label, count, first position): the label with most votes.

    A tie that includes ``neutral`` is neutral; any other tie goes to the label that occurs first. Any
    integer is a label; without one the result is null.
    """
    rank = F.struct((-n).alias("n"), (vote != neutral).alias("late"), first.isNull().alias("lost"), first.alias("first"), vote.alias("vote"))
    return F.min(F.when(vote.isNotNull(), rank))["vote"]


def vote_by_group(df: DataFrame, key: Sequence[str], label: str, order: str, name: str, neutral: int = NEUTRAL) -> DataFrame:
    """(key, ``name``): the vote of each group by ``winner``, from tallies that combine on the map side."""
    rows = df.select(*key, int_label(label).alias("_vote"), F.col(order).alias("_at"))
    tallies = rows.groupBy(*key, "_vote").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    return tallies.groupBy(*key).agg(winner(F.col("_vote"), F.col("_n"), F.col("_first"), neutral).alias(name))
