"""Writers. Each writes a folder of part files, in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from labelloom.operators.reviews import REVIEW_KEY, review_blocks
from labelloom.sources.tables import COMMA, TAB


def write_delimited(
    df: DataFrame, path: str, sep: str = COMMA, partition_by: Sequence[str] = (), mode: str = "error"
) -> None:
    """Header, quotes doubled inside quoted fields, white space kept; no byte-order mark."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(
        path,
        header=True,
        sep=sep,
        quote='"',
        escape='"',
        emptyValue="",
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_csv(df: DataFrame, path: str, **options) -> None:
    write_delimited(df, path, COMMA, **options)


def write_tsv(df: DataFrame, path: str, **options) -> None:
    write_delimited(df, path, TAB, **options)


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "error") -> None:
    """(text, label) tables, one folder per split."""
    write_csv(df.select("text", "label", split), path, partition_by=[split], mode=mode)


def write_review_blocks(reviews: DataFrame, path: str, key: Sequence[str] = REVIEW_KEY, mode: str = "error") -> None:
    """The text export: the part files, read in name order, hold the blocks in review order."""
    (
        review_blocks(reviews, key)
        .repartitionByRange("review_order")
        .sortWithinPartitions("review_order")
        .select("block")
        .write.mode(mode)
        .text(path, lineSep="\n")
    )


def write_metrics(metrics: DataFrame, path: str, form: str = "json", mode: str = "error") -> None:
    """A metric table (see ``evaluate.metric_table``) as JSON lines or Parquet."""
    metrics.write.mode(mode).format(form).save(path)
