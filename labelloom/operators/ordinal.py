"""Ordinals 1..n over a global order, without a one-partition window.

Rows are range-partitioned and sorted, the result is checkpointed (so partition contents are
fixed, whatever executor is lost later), and each row's ordinal is its place in its partition
plus the sizes of the partitions before it. Only one row per partition is summed up centrally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.session import cut_lineage

_PLACE_BITS = 33  # monotonically_increasing_id keeps the partition above its 33 low bits


def global_ordinal(df: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Add ``name`` = 1..n in ascending ``order`` (which should be unique)."""
    cols = [F.col(c) for c in order]
    ranged = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    fixed = cut_lineage(ranged).withColumn("_part", F.shiftright("_slot", _PLACE_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    place = F.col("_slot").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    # one row per shuffle partition, so the broadcast is bounded by the partition count
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + place + 1).cast("long"))
        .drop("_part", "_slot", "_before")
    )


def preview(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``. A partial aggregate, so a huge key is no hot task."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    picked = df.groupBy(*key).agg(first)
    return picked.select(*[c if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])
