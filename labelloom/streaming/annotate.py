"""Label incoming sentences as they arrive.

Cleaning, the join with a static review table and the vote keep no state, so the batch plan
runs on a stream as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from labelloom.functions.schema import with_known
from labelloom.functions.text import clean_text
from labelloom.plans.annotation import REVIEW_RATERS, distribute_labels


def annotate_stream(sentences: DataFrame, reviews: DataFrame, raters: Sequence[str] = REVIEW_RATERS) -> DataFrame:
    """Clean sentences and give them their review's labels and the merged label."""
    clean = with_known(sentences, "text", clean_text("text"))
    return distribute_labels(clean, reviews, raters)


def write_annotated(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet folder, exactly once, taking what is there and stopping."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
