import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from labelloom.operators.split import stratified_folds
from labelloom.operators.scoring import predict_linear, score_batches
from labelloom.plans import training as M
from labelloom.streaming.annotate import annotate_stream, write_annotated


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    marks = {0: "loše užas", 1: "onako može", 2: "super odlično"}
    noise = [f"riječ{i}" for i in range(30)]
    data = []
    for i in range(150):
        k = (0, 1, 1, 2, 2, 2)[i % 6]
        words = rng.choices(marks[k].split(), k=2) + rng.choices(noise, k=5)
        rng.shuffle(words)
        data.append((i, " ".join(words), k))
    return spark.createDataFrame(data, "doc long, text string, label int").repartition(4).cache()


def test_logistic_learns_saves_and_loads(corpus, tmp_path):
    model = M.fit(corpus, "doc", M.logistic(5.0))
    row = M.evaluate_on(model, {"same": corpus, "none": corpus.filter("label < 0")}).collect()
    assert [r["dataset"] for r in row] == ["same"]
    assert row[0]["support"] == 150 and row[0]["macro_f1"] > 0.95
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert sorted(M.predict(again, corpus).collect()) == sorted(M.predict(model, corpus).collect())
    bare = corpus.drop("label")
    assert M.predict(model, bare).count() == M.predict(model, corpus.withColumn("label", F.lit(None).cast("int"))).count() == corpus.count()


def test_features_match_the_relational_tfidf(corpus):
    from labelloom.functions.text import with_bigrams, word_tokens
    from labelloom.operators import tfidf as W
    from labelloom.operators import vocabulary as V

    for features in (M.Features(max_features=60), M.Features(max_features=80, min_df=2, sublinear=True)):
        tokens = with_bigrams(word_tokens("text"))
        stats = V.term_statistics(corpus, tokens, "doc")
        idf = W.idf_table(V.feature_vocabulary(stats, features.max_features, features.min_df), 150)
        rows = W.tfidf(corpus, tokens, "doc", idf, features.max_features, features.sublinear).collect()
        want = {(r["doc"], r["idx"]): r["weight"] for r in rows}

        terms = PipelineModel(stages=M.term_stages(features)).transform(corpus)
        stages, _ = M.vector_stages(stats, 150, features)
        vectors = PipelineModel(stages=stages).transform(terms).select("doc", "features").collect()
        got = {(r["doc"], int(i)): float(v) for r in vectors for i, v in zip(r["features"].indices, r["features"].values)}
        assert got == pytest.approx(want, abs=1e-12)


def test_cross_validation_covers_runs_and_folds(corpus):
    runs = {"C=1.0": M.logistic(1.0, 50), "C=5.0": M.logistic(5.0, 50)}
    out = M.cross_validate(corpus, "doc", runs).collect()
    assert {(r["run"], r["fold"]) for r in out} == {(run, f) for run in runs for f in range(5)}
    assert all(0.0 <= r["macro_f1"] <= 1.0 for r in out)
    assert sum(r["macro_f1"] for r in out if r["run"] == "C=5.0") / 5 > 0.8


def test_folds_learn_what_they_would_alone(corpus):
    """One table of counts for all folds gives the scores of a fit on each fold's own training rows."""
    small = M.Features(max_features=40)
    shared = {r["fold"]: r for r in M.cross_validate(corpus, "doc", {"x": M.logistic(1.0, 60)}, small).collect()}
    placed = stratified_folds(corpus, "label", "doc")
    for fold in (0, 3):
        model = M.fit(placed.filter(F.col("fold") != fold).drop("fold"), "doc", M.logistic(1.0, 60), small)
        alone = M.evaluate_on(model, {"x": placed.filter(F.col("fold") == fold)}).first()
        assert (alone["support"], alone["macro_f1"]) == (shared[fold]["support"], pytest.approx(shared[fold]["macro_f1"]))


def test_balanced_copies_keep_every_row(corpus):
    out = M.balance(corpus, "doc")
    assert out.select("doc").distinct().count() == 150
    counts = dict(map(tuple, out.groupBy("label").count().collect()))
    assert counts[2] == 75 and abs(counts[0] - 75) <= 15 and abs(counts[1] - 75) <= 15
    assert sorted(out.collect()) == sorted(M.balance(corpus.repartition(2), "doc").collect())


def test_weighted_logistic_and_perceptron(corpus):
    weighted = M.fit(corpus, "doc", M.logistic(1.0, 50, weight=M.WEIGHT), balanced="weights")
    assert M.evaluate_on(weighted, {"x": corpus}).first()["macro_f1"] > 0.9
    small = M.Features(max_features=60, min_df=2, sublinear=True)
    net = M.fit(corpus, "doc", M.perceptron(iterations=30), small, balanced="copies")
    assert M.predict(net, corpus).filter(~F.col("prediction").isin(0, 1, 2)).isEmpty()


def test_prepare_drops_what_cannot_be_learned_from(rows):
    df = rows([(1, " a ", "1.0"), (2, "\t", "1"), (3, None, "1"), (4, "b", "x")], "doc long, text string, label string")
    assert M.prepare(df).collect() == [(1, "a", 1)]


WEIGHTS = [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]


def load_model():
    return lambda batch: [[sum(w * x for w, x in zip(ws, v)) for ws in WEIGHTS] for v in batch["v"]]


def test_batched_scoring_agrees_with_the_native_path(spark):
    df = spark.range(500).select("id", F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("v"))
    a = predict_linear(df, "v", WEIGHTS).select("id", "prediction")
    b = score_batches(df.repartition(4), load_model, ["v"], ["id"]).select("id", "prediction")
    assert sorted(a.collect()) == sorted(b.collect())


def test_sentence_stream_gets_the_batch_labels(spark, tmp_path):
    from labelloom.plans.annotation import REVIEW_RATERS

    schema = "title string, review_id long, sentence_id long, text string, label_m int"
    data = [("T1", 1, 1, " ok <b>", 2), ("T1", 1, 2, "http://x", 1), ("T2", 1, 1, "x", 0)]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "in"))
    reviews = spark.createDataFrame(
        [("T1", 1, 0, 0, 0)], "title string, review_id long, " + ", ".join(f"{r} int" for r in REVIEW_RATERS)
    )
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = write_annotated(annotate_stream(stream, reviews), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).select("text", "label").collect()
    assert sorted(got) == [("ok ", 0), ("x", 0)]


def test_word_pairs_count_like_listed_terms(rows, monkeypatch):
    """Blocks of a few words, empty rows, a row larger than a block, words of other scripts, repeated ids."""
    from labelloom.functions.text import with_bigrams
    from labelloom.operators import vocabulary as V
    from labelloom.operators import wordpairs as W

    rng = random.Random(9)
    texts = [" ".join(rng.choices(["ab", "ba", "Čaj", "ИЖ", "東京", "x1", "a"], k=k)) for k in (0, 1, 2, 3, 40, 7, 0, 5, 9) * 3]
    df = rows([(i // 2, t, i % 3) for i, t in enumerate(texts)], "doc long, text string, fold int").coalesce(1)
    monkeypatch.setattr(W, "BLOCK", 11)
    words = PipelineModel(stages=M.term_stages(M.LOGISTIC_FEATURES)).transform(df)
    for pairs in (True, False):
        listed = with_bigrams("words") if pairs else F.col("words")
        want = V.term_statistics(words, listed, "doc").select("term", "tf", "df")
        assert sorted(W.word_statistics(words, "words", pairs).collect()) == sorted(want.collect())
        folds = V.fold_statistics(words, listed, "doc", 4)
        assert sorted(map(tuple, W.fold_word_statistics(words, "words", pairs, 4).select(folds.columns).collect())) == sorted(map(tuple, folds.collect()))

    # blocks, in this process: the workers keep their own size
    lists = pa.array([r["words"] for r in words.select("words").collect()], pa.list_(pa.string()))
    cuts = list(W._blocks(lists))
    assert len(cuts) > 5 and [a for a, _ in cuts] == [0, *[b for _, b in cuts[:-1]]] and cuts[-1][1] == len(lists)
    summed = Counter()
    for a, b in cuts:
        for part in W._tallies(lists.slice(a, b - a), np.arange(a, b) % 3, True):
            for term, fold, tf, df_ in zip(*(part[c].to_pylist() for c in ("term", "by", "tf", "df"))):
                summed.update({(term, fold, "tf"): tf, (term, fold, "df"): df_})
    by_fold = V.term_statistics(words, with_bigrams("words"), "doc", by=["fold"])
    assert summed == {(r["term"], r["fold"], c): r[c] for r in by_fold.collect() for c in ("tf", "df")}

    from labelloom.operators.tfidf import count_model

    chosen = ["ab", "ab ba", "ba ab", "čaj", "none", "none ab", "x1 東京", "иж иж"]
    old = count_model(chosen, "terms", "counts").transform(words.withColumn("terms", with_bigrams("words")))
    new = M.PairCounts(vocabulary=chosen).transform(words)
    assert [r["counts"] for r in new.collect()] == [r["counts"] for r in old.collect()]


def test_training_lists_no_pair_of_words(corpus):
    """A pair that occurs is never a row or a string: the fit's statistics and the model work on words."""
    model = M.fit(corpus, "doc", M.logistic(1.0, 5))
    assert [type(s).__name__ for s in model.stages[:2]] == ["RegexTokenizer", "PairCounts"]
    plan = M.predict(model, corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("ArrowEvalPython") == 1
