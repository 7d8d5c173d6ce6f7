"""Joins with a checked broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import settle

BROADCAST_ROWS = 200_000


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a broadcast if ``small`` is proven small, else let Spark shuffle (AQE splits skew).

    ``small`` is evaluated once, into a scratch table whose rows are counted; none reaches the driver.
    """
    table = settle(small, "small")
    return big.join(F.broadcast(table) if table.count() <= max_rows else table, list(on), how)
