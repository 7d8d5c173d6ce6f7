"""Trained models against runs of their own: features, fits and scores worked out with numpy from the raw texts."""

import math
import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators.split import stratified_folds
from labelloom.plans import training as M

CLASSES = 3


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts whose marks tell the label in two cases of three, so that models err."""
    rng = random.Random(11)
    marks = {0: "loše užas", 1: "onako može", 2: "super odlično"}
    noise = [f"riječ{i}" for i in range(25)]
    data = []
    for i in range(180):
        label = (0, 1, 1, 2, 2, 2)[i % 6]
        shown = label if rng.random() < 0.67 else rng.randrange(CLASSES)
        words = rng.choices(marks[shown].split(), k=1) + rng.choices(noise, k=5)
        rng.shuffle(words)
        data.append((i, " ".join(words), label))
    return spark.createDataFrame(data, "doc long, text string, label int").repartition(3).cache()


def terms_of(text):
    words = re.findall(r"\w\w+", text.lower())
    return words + [" ".join(pair) for pair in zip(words, words[1:])]


class Vectors:
    """Unit TF-IDF rows over all terms of the training texts."""

    def __init__(self, texts):
        df = Counter(t for text in texts for t in set(terms_of(text)))
        self.place = {t: k for k, t in enumerate(sorted(df))}
        self.idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}

    def __call__(self, texts):
        out = np.zeros((len(texts), len(self.place)))
        for row, text in zip(out, texts):
            for t, n in Counter(terms_of(text)).items():
                if t in self.place:
                    row[self.place[t]] = n * self.idf[t]
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_logistic(x, y, c, weights=None, steps=6000):
    """Weighted mean log loss + |W|^2 / (2 c n), by accelerated gradient steps; intercepts go free."""
    n = len(x)
    share = np.ones(n) / n if weights is None else weights / weights.sum()
    own = np.eye(CLASSES)[y]
    w, b = np.zeros((x.shape[1], CLASSES)), np.zeros(CLASSES)
    vw, vb = w, b
    for k in range(steps):
        off = (softmax(x @ vw + vb) - own) * share[:, None]
        nw, nb = vw - x.T @ off - vw / (c * n), vb - off.sum(axis=0)
        ahead = k / (k + 3)
        vw, vb = nw + ahead * (nw - w), nb + ahead * (nb - b)
        w, b = nw, nb
    return lambda rows: softmax(rows @ w + b)


def f1_scores(y, got):
    """accuracy, macro and weighted F1 over the classes that are there."""
    f1, size = [], []
    for k in sorted(set(y) | set(got)):
        hit = sum(a == b == k for a, b in zip(y, got))
        there, said = list(y).count(k), list(got).count(k)
        f1.append(2 * hit / (there + said))
        size.append(there)
    return np.mean(y == got), np.mean(f1), np.dot(f1, size) / sum(size)


def listed(df):
    rows = sorted(df.select("doc", "text", "label").collect())
    return [r["text"] for r in rows], np.array([r["label"] for r in rows])


def chances(model, df):
    rows = model.transform(M.with_text(df)).select("doc", "probability").collect()
    return np.array([r["probability"].toArray() for r in sorted(rows, key=lambda r: r["doc"])])


@pytest.mark.parametrize("c", [1.0, 5.0])
def test_logistic_agrees_with_a_fit_of_its_own(corpus, c):
    train, test = corpus.filter("doc % 4 <> 0"), corpus.filter("doc % 4 = 0")
    model = M.fit(train, "doc", M.logistic(c))
    texts, y = listed(train)
    unseen, truth = listed(test)
    vectors = Vectors(texts)
    own = fit_logistic(vectors(texts), y, c)(vectors(unseen))
    got = chances(model, test)
    assert got == pytest.approx(own, abs=0.01)
    row = M.evaluate_on(model, {"x": test}).first()
    assert (row["accuracy"], row["macro_f1"], row["weighted_f1"]) == pytest.approx(f1_scores(truth, own.argmax(axis=1)))
    assert 0.4 < row["accuracy"] < 1.0


def test_weighted_logistic_agrees_with_a_fit_of_its_own(corpus):
    model = M.fit(corpus, "doc", M.logistic(1.0, weight=M.WEIGHT), balanced="weights")
    texts, y = listed(corpus)
    x = Vectors(texts)(texts)
    sizes = np.bincount(y, minlength=CLASSES)
    own = fit_logistic(x, y, 1.0, weights=(len(y) / (CLASSES * sizes))[y])(x)
    assert chances(model, corpus) == pytest.approx(own, abs=0.01)
    assert np.abs(own - fit_logistic(x, y, 1.0)(x)).max() > 0.05  # the weights tell


def test_folds_of_strengths_agree_with_fits_of_their_own(corpus):
    runs = {"C=1.0": M.logistic(1.0), "C=5.0": M.logistic(5.0)}
    found = {(r["run"], r["fold"]): r for r in M.cross_validate(corpus, "doc", runs).collect()}
    placed = stratified_folds(corpus, "label", "doc").cache()
    assert len(found) == 10
    for fold in range(5):
        texts, y = listed(placed.filter(F.col("fold") != fold))
        unseen, truth = listed(placed.filter(F.col("fold") == fold))
        vectors = Vectors(texts)
        for c in (1.0, 5.0):
            guess = fit_logistic(vectors(texts), y, c)(vectors(unseen)).argmax(axis=1)
            row = found[f"C={c}", fold]
            assert row["support"] == len(truth)
            assert (row["accuracy"], row["macro_f1"], row["weighted_f1"]) == pytest.approx(f1_scores(truth, guess))


def test_perceptron_scores_are_those_of_its_weights(corpus):
    model = M.fit(corpus, "doc", M.perceptron(iterations=40), M.Features(max_features=60, min_df=2, sublinear=True), balanced="copies")
    net = model.stages[-1]
    rows = model.transform(M.with_text(corpus)).select("doc", "features", "probability", "prediction").collect()
    out = np.array([r["features"].toArray() for r in rows])
    flat, at = net.weights.toArray(), 0
    layers = [out.shape[1], *M.HIDDEN_LAYERS, CLASSES]
    for k, (a, b) in enumerate(zip(layers, layers[1:])):
        w = flat[at : at + a * b].reshape((b, a), order="F")
        at += a * b
        z = out @ w.T + flat[at : at + b]
        at += b
        out = softmax(z) if k == len(layers) - 2 else 1 / (1 + np.exp(-z))
    assert at == len(flat)
    assert np.array([r["probability"].toArray() for r in rows]) == pytest.approx(out, abs=1e-6)
    assert [r["prediction"] for r in rows] == out.argmax(axis=1).tolist()


@pytest.mark.parametrize("steps", [1, 4, 12])
def test_fits_side_by_side_take_mllibs_steps(spark, steps):
    """Few steps, so that the way counts and not only the end: five folds, two strengths, one class in a few rows,
    a term in every row, a row without a term of the vocabulary."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import array_to_vector

    from labelloom.plans import strengths as S
    from labelloom.plans.perceptron import sparse

    rng = random.Random(5)
    data = [(i, i % 4, (0, 0, 0, 2, 2, 1 if i in (4, 10) else 0)[i % 6], [rng.choice([0.0, 1.0, 1.0, 3.0]) * (i != 9) for _ in range(12)]) for i in range(80)]
    counted = spark.createDataFrame(data, "doc long, fold int, label int, n array<double>")
    counted = counted.select("doc", "fold", "label", array_to_vector("n").alias("counts")).cache()
    idf = np.array([[0.0 if (t + f) % 7 == 0 else 1.0 + t / 5 + f / 9 for f in range(4)] for t in range(12)])
    documents = {f: 60 for f in range(4)}
    runs = [S.Strength(1.0, steps, 1e-4), S.Strength(5.0, steps, 1e-4)]
    rows = counted.select("label", "fold", sparse("counts")[0].alias("column"), sparse("counts")[1].alias("value"))
    weights, bias = S._models(rows, idf, runs, documents)
    for f in range(4):
        train = PipelineModel(stages=M.weight_stages(list(idf[:, f]), "counts")).transform(counted.filter(F.col("fold") != f))
        for k, c in enumerate((1.0, 5.0)):
            alone = M.logistic(c, steps).fit(train, 60, 12)
            own = alone.coefficientMatrix.toArray().T * idf[:, [f]]
            classes = own.shape[1]
            assert weights[:, :classes, f, k] == pytest.approx(own, abs=1e-6)
            assert bias[:classes, f, k] - bias[:classes, f, k].mean() == pytest.approx(alone.interceptVector.toArray(), abs=1e-6)


def _scored(rows, labels, runs):
    rng = random.Random(8)
    data = [(i, " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee"], k=4) + [f"mark{k}"] * rng.randint(0, 1)), k) for i, k in enumerate(labels)]
    df = rows([*data, (90, "", 0), (91, "zz zz", labels[0])], "doc long, text string, label int")
    return sorted(map(tuple, M.cross_validate(df, "doc", runs, M.Features(max_features=12)).collect()))


@pytest.mark.parametrize("labels", [[0, 1, 0, 1, 1] * 6 + [2], [1] * 12], ids=["largest class in one fold only", "one class"])
def test_shared_passes_score_like_fits_alone(rows, labels):
    runs = {"a": M.logistic(1.0, 15), "b": M.logistic(5.0, 15)}
    alone = {name: replace(learner, strength=None) for name, learner in runs.items()}
    shared, want = _scored(rows, labels, runs), _scored(rows, labels, alone)
    assert [r[:3] for r in shared] == [r[:3] for r in want]
    assert [r[3:] for r in shared] == [pytest.approx(r[3:]) for r in want]


def test_a_pass_serves_the_fits_of_all_folds_and_strengths(corpus, monkeypatch):
    from labelloom.plans import strengths as S

    served, one_pass = [], S._pass

    def counted(own, weights, bias, folds):
        served.append(len(folds))
        return one_pass(own, weights, bias, folds)

    monkeypatch.setattr(S, "_pass", counted)
    M.cross_validate(corpus, "doc", {"a": M.logistic(1.0, 10), "b": M.logistic(5.0, 10)}).collect()
    assert served[0] == 10 and len(served) <= 25
