"""Text classification with MLlib: TF-IDF features, baseline models, cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassificationModel
from pyspark.ml.feature import (
    ElementwiseProduct,
    Normalizer,
    RegexTokenizer,
)
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.labels import int_label
from labelloom.functions.text import WORD_PATTERN, has_text, strip
from labelloom.operators.distribution import with_class_weights
from labelloom.operators.evaluate import scores
from labelloom.operators.split import class_sizes, fold_quotas, hash_key, place
from labelloom.operators.tfidf import count_model, smooth_idf
from labelloom.operators.vocabulary import feature_vocabulary, without_fold
from labelloom.operators.wordpairs import counts_of, fold_word_statistics, word_statistics
from labelloom.plans.perceptron import SparsePerceptron, prediction, sparse
from labelloom.plans.strengths import Strength, fold_predictions
from labelloom.session import cut_lineage, passing_table, settle


@dataclass(frozen=True)
class Features:
    """What the vectoriser keeps; the defaults are those of the logistic baseline."""

    max_features: int = 20_000
    bigrams: bool = True
    min_df: int = 1
    sublinear: bool = False


# Hyper-parameters of the baselines.
LOGISTIC_FEATURES = Features()
UNIGRAM_FEATURES = Features(bigrams=False)
PERCEPTRON_FEATURES = Features(max_features=30_000, min_df=2, sublinear=True)
HIDDEN_LAYERS = (128, 64)
LOGISTIC_ITERATIONS = 300
LOGISTIC_TOLERANCE = 1e-4
PERCEPTRON_ITERATIONS = 200

WEIGHT = "weight"
COPIES_PER_ROW = 1_000


@dataclass(frozen=True)
class Learner:
    """How to build an estimator from (rows, features); a ``strength`` if it is logistic and rows weigh alike."""

    build: Callable[[int, int], Estimator]
    strength: Strength | None = None

    def fit(self, train: DataFrame, rows: int, width: int) -> Model:
        return self.build(rows, width).fit(train)


@F.pandas_udf(VectorUDT())
def _damp(vectors: pd.DataFrame) -> pd.DataFrame:
    """1 + ln(n) for the values of a batch of sparse vectors, taken and given as their fields."""
    counts = vectors["values"]
    ends = np.cumsum(counts.str.len().to_numpy())
    flat = np.concatenate([*counts, np.empty(0)])
    return vectors.assign(values=pd.Series(np.split(1.0 + np.log(flat), ends)[: len(counts)], index=vectors.index))


class SublinearCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Replace each count n of a sparse vector by 1 + ln(n)."""

    def __init__(self, inputCol: str = "counts", outputCol: str = "damped"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), _damp(self.getInputCol()))


class PairCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts of the vocabulary's terms, words and pairs of neighbouring words, from an array of words."""

    vocabulary = Param(Params._dummy(), "vocabulary", "terms, by index", typeConverter=TypeConverters.toListString)

    def __init__(self, inputCol: str = "words", outputCol: str = "counts", vocabulary: Sequence[str] = ()):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, vocabulary=list(vocabulary))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), counts_of(self.getInputCol(), self.getOrDefault(self.vocabulary)))


def with_text(df: DataFrame) -> DataFrame:
    """Strip text, drop rows without any; a label, if there is one, is parsed."""
    known = df.filter(has_text("text")).withColumn("text", strip("text"))
    return known.withColumn("label", int_label("label")) if "label" in df.columns else known


def prepare(df: DataFrame) -> DataFrame:
    """Rows to learn from: with text and a label."""
    return with_text(df).filter(F.col("label").isNotNull())


def term_stages(features: Features) -> list[Transformer]:
    """text -> words, as pipeline stages; pairs of words are counted with them, not listed."""
    return [RegexTokenizer(inputCol="text", outputCol="words", pattern=WORD_PATTERN, gaps=False)]


def learn_vocabulary(stats: DataFrame, documents: int, features: Features, written: bool = False) -> dict[str, float]:
    """The chosen terms in order and their inverse document frequencies, at most ``max_features``."""
    vocabulary = feature_vocabulary(stats, features.max_features, features.min_df, written)
    rows = vocabulary.select("term", "idx", smooth_idf(F.lit(documents), "df").alias("idf")).collect()
    if not rows:
        raise ValueError("the corpus has no term to learn from")
    return {r["term"]: r["idf"] for r in sorted(rows, key=lambda r: r["idx"])}


def count_stages(terms: Sequence[str], features: Features) -> tuple[list[Transformer], str]:
    """words -> counts of the terms, damped ones if the features ask for it, and the name of their column."""
    stages: list[Transformer] = [PairCounts(vocabulary=terms) if features.bigrams else count_model(terms, "words", "counts")]
    if not features.sublinear:
        return stages, "counts"
    return [*stages, SublinearCounts(inputCol="counts", outputCol="damped")], "damped"


def weight_stages(weights: Sequence[float], counts: str) -> list[Transformer]:
    """counts -> unit TF-IDF vectors."""
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(list(weights)), inputCol=counts, outputCol="weighted")
    return [weigh, Normalizer(p=2.0, inputCol="weighted", outputCol="features")]


def vector_stages(stats: DataFrame, documents: int, features: Features) -> tuple[list[Transformer], int]:
    """words -> unit TF-IDF vectors. The vocabulary (at most ``max_features`` rows) is collected."""
    idf = learn_vocabulary(stats, documents, features)
    stages, counts = count_stages(list(idf), features)
    return [*stages, *weight_stages(list(idf.values()), counts)], len(idf)


def logistic(c: float = 1.0, iterations: int = LOGISTIC_ITERATIONS, weight: str | None = None) -> Learner:
    """Multinomial logistic regression with an L2 penalty of inverse strength ``c``."""

    def build(rows: int, width: int) -> Estimator:
        model = LogisticRegression(
            family="multinomial",
            regParam=1.0 / (c * rows),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=iterations,
            tol=LOGISTIC_TOLERANCE,
        )
        return model.setWeightCol(weight) if weight else model

    return Learner(build, None if weight else Strength(c, iterations, LOGISTIC_TOLERANCE))


def perceptron(classes: int = 3, iterations: int = PERCEPTRON_ITERATIONS, seed: int = 42) -> Learner:
    """Perceptron with the baseline's hidden layers (sigmoid units, L-BFGS)."""

    def build(rows: int, width: int) -> Estimator:
        return SparsePerceptron([width, *HIDDEN_LAYERS, classes], iterations, seed)

    return Learner(build)


def level(df: DataFrame, how: str | None, id_col: str) -> DataFrame:
    """Even out the classes: not at all, by row weights, or by repeating rows."""
    if how is None:
        return df
    if how == "weights":
        return with_class_weights(df)
    if how == "copies":
        return balance(df, id_col)
    raise ValueError(f"unknown way to balance: {how}")


def balance(df: DataFrame, id_col: str, label: str = "label", seed: int = 42) -> DataFrame:
    """Repeat the rows of rarer classes until classes weigh about the same.

    For learners without row weights. Every row is kept at least once; a fractional repeat is
    decided by the row's hash. The result has at most (classes x largest class) rows. Copies are
    dealt out in lots of ``COPIES_PER_ROW``, so that a class with one row fills many tasks.
    """
    sizes = class_sizes(df, label)
    largest = max(sizes.values())
    wanted = reduce(
        lambda acc, item: acc.when(F.col(label) == F.lit(item[0]), F.lit(largest / item[1])),
        sizes.items(),
        F.when(F.lit(False), F.lit(1.0)),
    )
    chance = F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("double") / float(16**8)
    whole = F.floor(wanted)
    copies = whole + F.when(chance < wanted - whole, 1).otherwise(0)
    first = F.sequence(F.lit(0).cast("long"), copies - 1, F.lit(COPIES_PER_ROW).cast("long"))
    lots = df.withColumn("_copies", copies).withColumn("_first", F.explode(first))
    dealt = lots.repartition(F.col(id_col), F.col("_first"))
    last = F.least(F.col("_first") + COPIES_PER_ROW, F.col("_copies")) - 1
    return dealt.withColumn("_copy", F.explode(F.sequence(F.col("_first"), last))).drop("_copies", "_first", "_copy")


def _evened(vectors: DataFrame) -> DataFrame:
    """Partitions of even bytes, sized by adaptive execution: an iterative fit reads them hundreds of times."""
    return cut_lineage(vectors.hint("rebalance"))


def fit(
    train: DataFrame,
    id_col: str,
    learner: Learner,
    features: Features = LOGISTIC_FEATURES,
    balanced: str | None = None,
) -> PipelineModel:
    """Text -> prediction as one saveable pipeline model.

    Texts are tokenised for the vocabulary and again for the vectors; only the vectors are kept.
    """
    head = term_stages(features)
    rows = prepare(train).select(id_col, "text", "label")
    words = PipelineModel(stages=head).transform(rows).select(id_col, "label", "words")
    documents = words.count()
    stages, width = vector_stages(word_statistics(words, "words", features.bigrams), documents, features)
    vectors = PipelineModel(stages=stages).transform(level(words, balanced, id_col))
    vectors = _evened(vectors.drop(id_col, "words", "counts", "damped", "weighted")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = learner.fit(vectors, documents, width)
    finally:
        vectors.unpersist()
    return PipelineModel(stages=[*head, *stages, model])


def feature_rows(model: PipelineModel, df: DataFrame, id_col: str) -> DataFrame:
    """(id, idx, weight): what the classifier of a fitted pipeline is given for each row with text."""
    features = PipelineModel(stages=model.stages[:-1]).transform(with_text(df).select(id_col, "text"))
    vector = F.unwrap_udt("features")
    return features.select(id_col, F.inline(F.arrays_zip(vector["indices"].alias("idx"), vector["values"].alias("weight"))))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """All rows with text and their integer ``prediction``, labelled or not; feature columns are left out."""
    *stages, last = model.stages
    if isinstance(last, MultilayerPerceptronClassificationModel):
        scored = PipelineModel(stages=stages).transform(with_text(df)).withColumn("prediction", prediction(last))
    else:
        scored = model.transform(with_text(df))
    return scored.select(*df.columns, F.col("prediction").cast("int").alias("prediction"))


def evaluate_on(model: PipelineModel, tests: Mapping[str, DataFrame]) -> DataFrame:
    """Scores per named test set, in one job."""
    parts = [
        predict(model, prepare(df)).select(F.lit(name).alias("dataset"), "label", "prediction")
        for name, df in tests.items()
    ]
    return scores(reduce(DataFrame.unionByName, parts), "label", "prediction", "dataset")


def _in_folds(df: DataFrame, id_col: str, features: Features, folds: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, label, fold, words) of the rows to learn from, and the rows of each fold, which the quotas tell."""
    known = prepare(df).select(id_col, "text", "label")
    placed, quotas = place(known, "label", id_col, lambda sizes: fold_quotas(sizes, folds), "fold", seed)
    rows = {f: sum(q[f] for q in quotas.values()) for f in range(folds)}
    return PipelineModel(stages=term_stages(features)).transform(placed).select(id_col, "label", "fold", "words"), rows


def fold_vocabularies(
    df: DataFrame, id_col: str, features: Features = LOGISTIC_FEATURES, folds: int = 5, seed: int = 42
) -> DataFrame:
    """(fold, term, idx, tf, df, idf): what cross-validation learns before it scores each fold."""
    words, rows = _in_folds(df, id_col, features, folds, seed)
    stats = settle(fold_word_statistics(words, "words", features.bigrams, folds), "terms")
    parts = []
    for fold in range(folds):
        documents = F.lit(sum(n for f, n in rows.items() if f != fold))
        chosen = feature_vocabulary(without_fold(stats, fold), features.max_features, features.min_df, written=True)
        parts.append(chosen.select(F.lit(fold).alias("fold"), "term", "idx", "tf", "df", smooth_idf(documents, "df").alias("idf")))
    return reduce(DataFrame.unionByName, parts)


def cross_validate(
    df: DataFrame,
    id_col: str,
    runs: Mapping[str, Learner],
    features: Features = LOGISTIC_FEATURES,
    folds: int = 5,
    seed: int = 42,
    balanced: str | None = None,
    parallelism: int | None = None,
) -> DataFrame:
    """(run, fold, support, accuracy, macro_f1, weighted_f1): every run on every fold.

    The vocabulary and the document frequencies of a fold's training rows leave out that fold. They
    come from one pass over the corpus: a term's row keeps its statistics for each fold, and a fold's
    own part is taken off the sum. A second pass counts the terms of all folds' vocabularies, at most folds x
    ``max_features``, in one table that all folds and runs read. A fold weighs the counts by its own
    frequencies, terms outside its vocabulary by zero, so it learns from what it would have alone.
    Logistic runs without balancing share their passes: each reads the counts once for the fits of all
    folds and runs (``strengths``). Other learners are trained a fold each, side by side, so that their many
    short jobs fill each other's gaps; each keeps its training rows in the executors meanwhile (on disk what
    does not fit), fewer at a time with a lower ``parallelism``. All folds are scored in one job.
    """
    words, rows = _in_folds(df, id_col, features, folds, seed)
    documents = {fold: sum(n for f, n in rows.items() if f != fold) for fold in range(folds)}
    with passing_table(fold_word_statistics(words, "words", features.bigrams, folds), "terms") as stats:
        learn = lambda fold: learn_vocabulary(without_fold(stats, fold), documents[fold], features, written=True)
        with ThreadPool(folds) as pool:
            idf = dict(enumerate(pool.map(inheritable_thread_target(df.sparkSession)(learn), range(folds))))
    union = sorted(set().union(*idf.values()))
    stages, counts = count_stages(union, features)
    counted = PipelineModel(stages=stages).transform(words).select(id_col, "label", "fold", counts)
    counted = _evened(counted)
    if balanced is None and all(learner.strength for learner in runs.values()):
        weights = np.array([[idf[fold].get(t, 0.0) for fold in range(folds)] for t in union])
        strengths = {run: learner.strength for run, learner in runs.items()}
        predictions = [cut_lineage(fold_predictions(counted, sparse(counts), weights, strengths, documents))]
        return _fold_scores(predictions)
    counted = counted.persist(StorageLevel.MEMORY_AND_DISK)

    def one_fold(fold: int) -> DataFrame:
        weigh = PipelineModel(stages=weight_stages([idf[fold].get(t, 0.0) for t in union], counts))
        train = weigh.transform(level(counted.filter(F.col("fold") != fold), balanced, id_col))
        train = train.drop(id_col, "fold", counts, "weighted")
        held = weigh.transform(counted.filter(F.col("fold") == fold)).select("label", "fold", "features")
        done = []
        for run, learner in runs.items():
            out = learner.fit(train, documents[fold], len(union)).transform(held)
            dataset = F.struct(F.lit(run).alias("run"), "fold").alias("dataset")
            done.append(out.select(dataset, "label", F.col("prediction").cast("int").alias("prediction")))
        # fixed before the cached counts are let go
        return cut_lineage(reduce(DataFrame.unionByName, done))

    try:
        with ThreadPool(min(parallelism or folds, folds)) as pool:
            task = inheritable_thread_target(df.sparkSession)(one_fold)
            predictions = pool.map(task, range(folds))
    finally:
        counted.unpersist()
    return _fold_scores(predictions)


def _fold_scores(predictions: Sequence[DataFrame]) -> DataFrame:
    result = scores(reduce(DataFrame.unionByName, predictions), "label", "prediction", "dataset")
    return result.select("dataset.run", "dataset.fold", "support", "accuracy", "macro_f1", "weighted_f1")
