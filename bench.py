"""Time the headline queries; prints one JSON line.

Results go to Spark's no-op sink, so whole results are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from labelloom.catalog import ENTRIES
from labelloom.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "p01_clean_text",
    "p12_bigrams",
    "a2_assemble_reviews",
    "a3_review_agreement",
    "a10_agreement_summary",
    "distribute_labels",
    "w4_stratified_split",
    "w5_stratified_folds",
    "e5_classification_report",
    "e6_scores_by_dataset",
    "t1_token_counts",
    "t2_top_vocabulary",
    "t3_feature_vocabulary",
    "t4_term_frequency",
    "t6_tfidf",
    "p13_encode",
    "m5_linear_scores",
    "u4_batched_scores",
    "m1_logistic_regression",
    "m2_fold_vocabularies",
    "k7_model_round_trip",
)
SCORING = "u4_batched_scores"


def seconds(spark, name: str) -> float:
    start = time.perf_counter()
    ENTRIES[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS)
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    times = {}
    for name in names:
        runs = [seconds(spark, name)]
        if runs[0] < 15:
            runs.append(seconds(spark, name))
        times[name] = round(min(runs), 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    if SCORING in times:
        rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
        result["scored_samples_per_sec"] = round(rows / times[SCORING], 1)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
