"""Column-name helpers and input guards. None of them scans data unless it says so."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted names of the text and the label column, first match wins.
TEXT_NAMES = ("text", "sentence", "review", "content")
LABEL_NAMES = ("sentiment", "label", "labels")

# Label columns of earlier annotation runs, replaced by a new run.
STALE_LABELS = (
    "label_perplexity",
    "label_copilot",
    "label",
    "label_chatgpt_review",
    "label_perplexity_review",
    "label_copilot_review",
    "label_ai_review_majority",
)


def normalize_header(df: DataFrame, lower: bool = True) -> DataFrame:
    """Strip column names and, by default, lower them."""
    names = [c.strip() for c in df.columns]
    return df.toDF(*[n.lower() if lower else n for n in names])


class Roles(NamedTuple):
    """``column``: what plays each role; ``spare``: further columns that could, in order of preference."""

    column: dict[str, str]
    spare: dict[str, list[str]]


def resolve(df: DataFrame, roles: Mapping[str, Sequence[str]]) -> Roles:
    """Find a column for every role among its accepted names, the earlier name first; case counts.

    All roles that no column can play are reported in one error.
    """
    ranked: dict[str, list[tuple[int, str]]] = {role: [] for role in roles}
    wanted = [(name, role, rank) for role, names in roles.items() for rank, name in enumerate(names)]
    for name, role, rank in wanted:
        if name in df.columns:
            ranked[role].append((rank, name))
    missing = sorted(role for role, hits in ranked.items() if not hits)
    if missing:
        accepted = {role: list(roles[role]) for role in missing if list(roles[role]) != [role]}
        raise ValueError(f"missing columns {missing}; existing columns {df.columns}" + (f"; accepted names {accepted}" if accepted else ""))
    order = {role: [name for _, name in sorted(hits)] for role, hits in ranked.items()}
    return Roles({role: names[0] for role, names in order.items()}, {role: names[1:] for role, names in order.items() if names[1:]})


def text_and_label(df: DataFrame) -> DataFrame:
    """Only the text and the label column, under their standard names, complete rows only."""
    found = resolve(df, {"text": TEXT_NAMES, "label": LABEL_NAMES}).column
    return (
        df.select(*[F.col(column).alias(role) for role, column in found.items()])
        .na.drop(subset=["text", "label"])
        .select(F.col("text").cast("string").alias("text"), F.col("label").cast("double").cast("int").alias("label"))
    )


def drop_stale_labels(df: DataFrame, names: Sequence[str] = STALE_LABELS) -> DataFrame:
    """Drop the columns of ``names`` that exist."""
    return df.drop(*names)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Raise if a column is missing; returns ``df``."""
    resolve(df, {name: (name,) for name in names})
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    """Raise if there is no row (runs a job that stops at the first row); returns ``df``."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a null in a key belong to no group and match no other row.

    Plain null tests, one per key: those reach the Parquet scan.
    """
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def with_known(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Set column ``name`` to ``value`` and drop the rows where that is null.

    The value is computed once per row. A filter on it would be pushed below the projection and
    compute it again, which is dear for text.
    """
    known = F.explode(F.array_compact(F.array(value))).alias(name)
    names = df.columns if name in df.columns else [*df.columns, name]
    return df.select(*[known if c == name else F.col(f"`{c}`") for c in names])
