from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.operators import evaluate as E

# Published confusion matrices (rows true, columns predicted) and their scores.
PUBLISHED = {
    "in": ([[121, 57, 8], [33, 764, 96], [4, 27, 262]], 0.8360058309037901, 0.8430966911106264, 0.8364237223994172, 0.7920963497),
    "out": ([[48, 19, 1], [18, 71, 63], [10, 31, 275]], 0.7350746268656716, 0.7247754365, 0.7271252161, 0.6755026144),
}


@pytest.fixture
def predictions(rows):
    data = [
        (name, t, p)
        for name, (matrix, *_) in PUBLISHED.items()
        for t, line in enumerate(matrix)
        for p, n in enumerate(line)
        for _ in range(n)
    ]
    return rows(data, "dataset string, t int, p int").repartition(5)


def test_published_scores(predictions):
    got = {r["dataset"]: r for r in E.scores(predictions, "t", "p", "dataset").collect()}
    for name, (matrix, accuracy, precision, f1, macro) in PUBLISHED.items():
        r = got[name]
        assert r["support"] == sum(map(sum, matrix))
        assert r["accuracy"] == pytest.approx(accuracy, abs=1e-12)
        assert r["weighted_precision"] == pytest.approx(precision, abs=1e-9)
        assert r["weighted_recall"] == pytest.approx(accuracy, abs=1e-12)
        assert r["weighted_f1"] == pytest.approx(f1, abs=1e-9)
        assert r["macro_f1"] == pytest.approx(macro, abs=1e-9)
    accuracies = dict(map(tuple, E.accuracy(predictions, "t", "p", "dataset").collect()))
    assert accuracies["in"] == pytest.approx(PUBLISHED["in"][1], abs=1e-12)


def test_published_matrix_and_report(predictions):
    cells = E.confusion_matrix(predictions, "t", "p", "dataset").collect()
    for name, (matrix, *_) in PUBLISHED.items():
        got = {(r["true_label"], r["predicted_label"]): r["count"] for r in cells if r["dataset"] == name}
        assert got == {(t, p): matrix[t][p] for t in range(3) for p in range(3)}
    report = {(r["dataset"], r["class"]): r for r in E.classification_report(predictions, "t", "p", "dataset").collect()}
    row = report[("in", "1")]
    assert [round(row[c], 2) for c in ("precision", "recall", "f1")] == [0.90, 0.86, 0.88]
    assert row["support"] == 893
    macro = report[("in", "macro avg")]
    assert [round(macro[c], 10) for c in ("precision", "recall", "f1")] == [0.7942043919, 0.8000928999, 0.7920963497]
    assert report[("out", "accuracy")]["precision"] is None


def test_labels_are_the_union_and_empty_ratios_are_zero(rows):
    df = rows([(0, 3), (0, 0), (None, 1), (1, None)], "t int, p int")
    cells = {(r["true_label"], r["predicted_label"]): r["count"] for r in E.confusion_matrix(df, "t", "p").collect()}
    assert cells == {(0, 0): 1, (0, 3): 1, (3, 0): 0, (3, 3): 0}
    row = E.scores(df, "t", "p").first()
    assert (row["support"], row["accuracy"]) == (2, 0.5)
    assert row["macro_precision"] == 0.5 and row["macro_recall"] == 0.25
    assert row["macro_f1"] == pytest.approx((2 / 3) / 2)


# Published fold scores with their mean and population standard deviation.
FOLDS = [
    ([0.5478, 0.5552, 0.5295, 0.5123, 0.5497], 0.5389, 0.0159),
    ([0.5865, 0.6179, 0.5710, 0.5924, 0.6174], 0.5970, 0.0182),
    ([0.5616, 0.6138, 0.5790, 0.5855, 0.6181], 0.5916, 0.0214),
]


@pytest.mark.parametrize("scores, mean, std", FOLDS)
def test_published_fold_summaries(rows, scores, mean, std):
    row = E.fold_summary(rows([(s,) for s in scores], "f1 double"), "f1").first()
    assert (row["mean"], row["std"]) == (pytest.approx(mean, abs=1e-4), pytest.approx(std, abs=1e-4))


def test_best_run_takes_the_earliest_of_equal_scores(rows):
    df = rows([(1, 0.5, "a"), (2, 0.7, "b"), (3, 0.7, "c"), (4, None, "d")], "run int, f1 double, note string")
    assert E.best_run(df, "f1", "run").collect() == [(2, 0.7, "b")]
    assert E.best_run(df.filter("run = 4"), "f1", "run").collect() == []


def test_prediction_tables(rows):
    df = rows([("x", 1, 2), ("y", 1, 1)], "text string, t int, p int")
    a = E.prediction_table(df, "text", "t", "p")
    assert (a.columns, a.first()) == (["text", "prediction_label", "truth_label"], ("x", 2, 1))
    b = E.prediction_table(df, "text", "t", "p", correct=True)
    assert [r["correct"] for r in b.collect()] == [False, True]


def test_metric_table_has_one_number_per_row(predictions):
    got = E.metric_table(predictions, "t", "p", "dataset").collect()
    # three classes and two averages with four numbers each; accuracy with f1 and support
    assert len(got) == 2 * (5 * 4 + 2)
    assert all(r["value"] is not None for r in got)


def test_many_classes(spark):
    k = 500
    df = spark.range(k * 4).select((F.col("id") % k).alias("t"), ((F.col("id") * 7 + F.col("id") % 2) % k).alias("p"))
    pairs = [(i % k, (i * 7 + i % 2) % k) for i in range(k * 4)]
    matrix = E.confusion_matrix(df, "t", "p")
    assert matrix.count() == k * k
    want = Counter(pairs)
    got = {(r["true_label"], r["predicted_label"]): r["count"] for r in matrix.filter("count > 0").collect()}
    assert got == want
    hits = sum(t == p for t, p in pairs)
    assert E.scores(df, "t", "p").first()["accuracy"] == hits / len(pairs)
    assert E.classification_report(df, "t", "p").count() == k + 3


def test_report_has_a_line_for_a_class_that_is_only_predicted(rows):
    report = E.classification_report(rows([(0, 0), (0, 1), (None, 0), (0, None)], "t int, p int"), "t", "p")
    lines = {r["class"]: (r["precision"], r["recall"], r["support"]) for r in report.collect()}
    assert lines["0"] == (1.0, 0.5, 2) and lines["1"] == (0.0, 0.0, 0)
    assert lines["macro avg"] == (0.5, 0.25, 2) and lines["weighted avg"] == (1.0, 0.5, 2)
