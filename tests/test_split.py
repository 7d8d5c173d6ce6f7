import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom import session
from labelloom.operators import split as P


def test_published_split_sizes():
    sizes = {0: 930, 1: 4465, 2: 1465}
    quotas = P.holdout_quotas(sizes)
    total = Counter()
    for k, parts in quotas.items():
        assert sum(parts.values()) == sizes[k]
        total.update(parts)
    assert dict(total) == {"train": 5145, "val": 343, "test": 1372}
    assert {k: q["test"] for k, q in quotas.items()} == {0: 186, 1: 893, 2: 293}


def test_share_out_keeps_the_total():
    assert P.share_out({0: 1, 1: 1, 2: 1}, 2) == {0: 1, 1: 1, 2: 0}
    assert sum(P.share_out({0: 5, 1: 90, 2: 7}, 33).values()) == 33


@pytest.mark.parametrize("sizes", [{0: 7, 1: 11, 2: 3}, {0: 1}, {5: 2, 9: 100}])
def test_fold_quotas_are_even(sizes):
    quotas = P.fold_quotas(sizes, 5)
    per_fold = Counter()
    for k, q in quotas.items():
        assert sum(q.values()) == sizes[k]
        assert max(q.values()) - min(q.values()) <= 1
        per_fold.update(q)
    assert max(per_fold.values()) - min(per_fold.values()) <= 1


@pytest.fixture
def table(spark):
    # one class holds nearly all rows
    label = F.when(F.col("id") % 50 == 0, 0).when(F.col("id") % 20 == 1, 2).otherwise(1)
    return spark.range(3000).select(F.col("id").alias("doc"), label.alias("label")).repartition(7)


def brute_force(table, quotas, seed=42):
    want = {}
    for k, parts in quotas.items():
        ids = [r["doc"] for r in table.filter(F.col("label") == k).collect()]
        ids.sort(key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
        names = [p for p, n in parts.items() for _ in range(n)]
        want.update(zip(ids, names, strict=True))
    return want


@pytest.mark.parametrize("digits", [1, 3])
def test_split_matches_brute_force(table, digits):
    quotas = P.holdout_quotas(P.class_sizes(table, "label"))
    out = P.assign(table, "label", "doc", quotas, "split", bucket_digits=digits)
    assert {r["doc"]: r["split"] for r in out.collect()} == brute_force(table, quotas)


def test_large_buckets_are_split_until_they_are_small(table, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 4)
    quotas = P.holdout_quotas(P.class_sizes(table, "label"))
    out = P.assign(table, "label", "doc", quotas, "split", bucket_digits=1)
    assert {r["doc"]: r["split"] for r in out.collect()} == brute_force(table, quotas)


def test_folds_match_brute_force_and_cover_all_rows(table):
    out = {r["doc"]: r["fold"] for r in P.stratified_folds(table, "label", "doc").collect()}
    assert out == brute_force(table, P.fold_quotas(P.class_sizes(table, "label")))


def test_split_does_not_depend_on_partitioning(table):
    a = P.stratified_split(table, "label", "doc", seed=7).collect()
    b = P.stratified_split(table.repartition(3), "label", "doc", seed=7).collect()
    assert sorted(a) == sorted(b)
    assert sorted(a) != sorted(P.stratified_split(table, "label", "doc", seed=8).collect())


def test_rows_are_not_shuffled(table, spark, tmp_path):
    table.write.parquet(str(tmp_path / "t"))
    out = P.stratified_split(spark.read.parquet(str(tmp_path / "t")), "label", "doc")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_tiny_classes_and_string_ids(rows):
    df = rows([("a", 0), ("b", 1), ("c", 1), ("d", None)], "doc string, label int")
    out = P.stratified_split(df, "label", "doc").collect()
    assert len(out) == 3 and all(r["split"] in ("train", "val", "test") for r in out)


@pytest.mark.parametrize("folds", [True, False])
def test_many_classes(spark, folds):
    df = spark.range(2000).select(F.col("id").alias("doc"), (F.col("id") * 37 % 90).cast("int").alias("label"))
    sizes = P.class_sizes(df, "label")
    quotas = P.fold_quotas(sizes) if folds else P.holdout_quotas(sizes)
    out = P.assign(df, "label", "doc", quotas, "part")
    assert out.columns == ["doc", "label", "part"]
    assert {r["doc"]: r["part"] for r in out.collect()} == brute_force(df, quotas)


def test_the_input_is_evaluated_twice(spark, table):
    """Once for the narrow table of hashes, once for the result; the narrow table is gone afterwards."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = table.mapInArrow(counted, table.schema)
    before = len(session._SCRATCH)
    for make in (P.stratified_split, P.stratified_folds):
        start = seen.value
        assert make(watched, "label", "doc").count() == 3000
        make(watched, "label", "doc").collect()
        assert seen.value - start <= 4 * 3000
    assert len(session._SCRATCH) == before
