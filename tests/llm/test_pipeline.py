"""The pipeline, stage by stage, against the plain versions of what each stage decides."""

import corpus_pipeline
from labelloom.llm import leaks, mixing, rules
from labelloom.session import settle
from tests.llm import brute
from tests.llm.conftest import pairs
from tests.llm.test_exact import plain_spans

BASE = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns = docs.columns
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        new = settle(stage(spark, docs, BASE))
        steps.append((docs, new))
        docs = new
    assert all(new.columns == columns for _, new in steps[:-1])

    raw, good = steps[0]
    verdict = {r["doc_id"]: r["kept"] for r in rules.quality(raw).collect()}
    assert sorted(d for d, _ in pairs(good)) == sorted(d for d, k in verdict.items() if k)

    good, single = steps[1]
    groups = {c for _, _, c in brute.simhash_components(pairs(good), 3, 2)}
    assert {d for d, _ in pairs(single)} == groups and single.count() == len(groups)

    single, clean = steps[2]
    items = spark.read.parquet(f"{BASE}/benchmark.parquet")
    bad = {r["doc_id"] for r in leaks.find_leaks(single, items).collect()}
    assert {d for d, _ in pairs(clean)} == {d for d, _ in pairs(single)} - bad
    assert not [d for d, t in pairs(clean) for r in items.collect() if r["text"] in t]

    clean, hidden = steps[3]
    assert {d for d, _ in pairs(hidden)} == {d for d, _ in pairs(clean)}
    was = dict(pairs(clean))
    for d, t in pairs(hidden):
        assert not plain_spans(t)
        assert plain_spans(was[d]) or was[d] == t
    assert not hidden.filter("n_chars <> length(text)").count()

    hidden, mixed = steps[4]
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(hidden).filter("copies > 0").collect()))
    assert corpus_pipeline.run(spark, BASE).count() == mixed.count()


def test_empty(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, BASE))
        assert docs.count() == 0
