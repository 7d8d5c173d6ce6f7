"""Training and scoring."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from labelloom.catalog.entry import query
from labelloom.catalog.evaluation import SQL_FOLDS, SQL_HOLDOUT, SQL_RANKED, rounded
from labelloom.catalog.features import sql_features, sql_terms
from labelloom.catalog.inputs import SQL_CLASSIFIED, classified, table
from labelloom.operators import evaluate as E
from labelloom.operators.scoring import predict_linear, score_batches
from labelloom.operators.split import stratified_split
from labelloom.plans import training as M
from labelloom.session import scratch_path

WIDTH = 64
WEIGHTS = [[((i * (k + 1)) % 7 - 3) / 10 for i in range(WIDTH)] for k in range(3)]

SQL_SCORED = "SELECT vec_id, {} FROM embeddings".format(
    ", ".join(
        f"list_dot_product(CAST(embedding AS DOUBLE[]), [{', '.join(map(str, w))}]::DOUBLE[]) AS s{k}"
        for k, w in enumerate(WEIGHTS)
    )
)
SQL_BEST = f"""SELECT vec_id, CAST(CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS INTEGER) AS prediction
  FROM ({SQL_SCORED})"""


@query("m5_linear_scores", SQL_BEST)
def linear(spark, folder):
    return predict_linear(table(spark, folder, "embeddings"), "embedding", WEIGHTS).select("vec_id", "prediction")


def _load_linear():
    import numpy as np

    weights = np.array(WEIGHTS)
    return lambda batch: list(np.stack(batch["embedding"].to_numpy()).astype(float) @ weights.T)


@query("u4_batched_scores", SQL_BEST)
def batched(spark, folder):
    scored = score_batches(table(spark, folder, "embeddings"), _load_linear, ["embedding"], ["vec_id"])
    return scored.select("vec_id", "prediction")


def _corpus(spark, folder):
    return classified(spark, folder).select("doc_id", "text", "lang", "label")


def _train_and_tests(spark, folder):
    """In-domain: one language, split; out of domain: the other languages."""
    df = _corpus(spark, folder)
    home = stratified_split(M.prepare(df.filter("lang = 'en'")), "label", "doc_id")
    train, val, test = (home.filter(F.col("split") == s) for s in ("train", "val", "test"))
    away = M.prepare(df.filter("lang <> 'en' or lang is null"))
    return train, {"validation": val, "in-domain": test, "out-of-domain": away}


# The same rows as SQL: those with text, by language, split.
SQL_KNOWN = "known AS (SELECT * FROM cls WHERE regexp_matches(text, '\\S'))"
SQL_HOME = f"""{SQL_CLASSIFIED}, {SQL_KNOWN}, home AS (SELECT * FROM known WHERE lang = 'en'),
{SQL_RANKED.replace("FROM cls", "FROM home")}, {SQL_HOLDOUT}"""


def _scores(df):
    return df.select("dataset", "support", "accuracy", "macro_f1", "weighted_f1")


@query("m1_logistic_regression")
def logistic(spark, folder):
    train, tests = _train_and_tests(spark, folder)
    return _scores(M.evaluate_on(M.fit(train, "doc_id", M.logistic(1.0)), tests))


@query("m1_logistic_unigrams_on_training_rows")
def unigrams(spark, folder):
    train, _ = _train_and_tests(spark, folder)
    model = M.fit(train, "doc_id", M.logistic(1.0), M.UNIGRAM_FEATURES)
    return _scores(M.evaluate_on(model, {"train": train}))


@query(
    "m1_training_vectors",
    f"""WITH {SQL_HOME}, learnt AS (SELECT doc_id, text FROM known JOIN placed USING (doc_id) WHERE split = 'train'),
        {sql_features(source="learnt")},
        w AS (SELECT doc_id, idx, p.tf * (ln((1 + (SELECT count(*) FROM learnt)) / CAST(1 + df AS DOUBLE)) + 1) AS w
              FROM pairs p JOIN feats USING (term))
        SELECT doc_id, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
)
def vectors(spark, folder):
    """What the logistic model is given of its training rows."""
    train, _ = _train_and_tests(spark, folder)
    model = M.fit(train, "doc_id", M.logistic(1.0))
    return rounded(M.feature_rows(model, train, "doc_id"))


@query(
    "m1_learns_its_training_rows",
    f"""WITH {SQL_HOME}, sized AS (SELECT label, count(*) AS n FROM placed WHERE split = 'train' GROUP BY label)
        SELECT 'train' AS dataset, CAST(sum(n) AS BIGINT) AS support, true AS beats_majority, true AS within_bounds FROM sized""",
)
def learns(spark, folder):
    """Scores of the logistic model on its own training rows lie within 0..1, above the share of the largest class."""
    train, _ = _train_and_tests(spark, folder)
    model = M.fit(train, "doc_id", M.logistic(1.0), M.UNIGRAM_FEATURES)
    sizes = train.groupBy(F.lit("train").alias("dataset"), "label").count()
    largest = sizes.groupBy("dataset").agg((F.max("count") / F.sum("count")).alias("majority"))
    own = M.evaluate_on(model, {"train": train}).join(largest, "dataset")
    within = [F.col(c).between(0, 1) for c in ("accuracy", "macro_f1", "weighted_f1")]
    return own.select(
        "dataset",
        "support",
        (F.col("accuracy") > F.col("majority")).alias("beats_majority"),
        (within[0] & within[1] & within[2]).alias("within_bounds"),
    )


@query(
    "m2_fold_vocabularies",
    f"""WITH {SQL_CLASSIFIED}, {SQL_KNOWN}, {SQL_RANKED.replace("FROM cls", "FROM known")}, {SQL_FOLDS}, {sql_terms("known")},
        stats AS (SELECT CAST(k.f AS INTEGER) AS fold, term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df
                  FROM pairs JOIN folded USING (doc_id) JOIN range(5) AS k(f) ON folded.fold <> k.f GROUP BY ALL),
        chosen AS (SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY fold ORDER BY tf DESC, term) <= {M.LOGISTIC_FEATURES.max_features}),
        docs AS (SELECT k.f AS fold, count(*) AS n FROM folded JOIN range(5) AS k(f) ON folded.fold <> k.f GROUP BY ALL)
        SELECT fold, term, CAST(row_number() OVER (PARTITION BY fold ORDER BY term) - 1 AS INTEGER) AS idx, tf, df,
               round(ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1, 6) AS idf
        FROM chosen JOIN docs USING (fold)""",
)
def fold_vocabularies(spark, folder):
    """Vocabulary and weights of every fold, learnt from the others."""
    return rounded(M.fold_vocabularies(_corpus(spark, folder), "doc_id"))


@query("m2_cross_validation")
def cross_validation(spark, folder):
    return M.cross_validate(_corpus(spark, folder), "doc_id", {"C=1.0": M.logistic(1.0)})


@query("m3_balanced_perceptron")
def perceptron(spark, folder):
    train, tests = _train_and_tests(spark, folder)
    model = M.fit(train, "doc_id", M.perceptron(), M.PERCEPTRON_FEATURES, balanced="copies")
    return _scores(M.evaluate_on(model, tests))


SQL_TRAINED = f"""{SQL_HOME}, trained AS (SELECT doc_id, label FROM placed WHERE split = 'train'),
sized AS (SELECT label, count(*) AS n FROM trained GROUP BY label)"""


@query(
    "m3_balanced_copies",
    f"""WITH {SQL_TRAINED},
        wanted AS (SELECT label, (SELECT max(n) FROM sized) / CAST(n AS DOUBLE) AS w FROM sized),
        drawn AS (SELECT doc_id, label, w, CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS chance
                  FROM trained JOIN wanted USING (label))
        SELECT doc_id, CAST(label AS INTEGER) AS label, CAST(floor(w) AS BIGINT) + CASE WHEN chance < w - floor(w) THEN 1 ELSE 0 END AS copies FROM drawn""",
)
def balanced_copies(spark, folder):
    """How often the perceptron is given each of its training rows."""
    train, _ = _train_and_tests(spark, folder)
    rows = M.balance(M.prepare(train).select("doc_id", "label"), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "m3_row_weights",
    f"""WITH {SQL_TRAINED}
        SELECT doc_id, CAST(label AS INTEGER) AS label, round((SELECT sum(n) FROM sized) / ((SELECT count(*) FROM sized) * CAST(n AS DOUBLE)), 6) AS weight
        FROM trained JOIN sized USING (label)""",
)
def row_weights(spark, folder):
    """The weights of the logistic model's training rows."""
    train, _ = _train_and_tests(spark, folder)
    return rounded(M.level(M.prepare(train).select("doc_id", "label"), "weights", "doc_id"))


@query("m3_weighted_logistic")
def weighted(spark, folder):
    train, tests = _train_and_tests(spark, folder)
    model = M.fit(train, "doc_id", M.logistic(1.0, weight=M.WEIGHT), M.LOGISTIC_FEATURES, balanced="weights")
    return _scores(M.evaluate_on(model, tests))


@lru_cache(maxsize=1)
def _strengths(spark, folder):
    """Ten fits; the scores, one row a fold, serve both queries of a session."""
    runs = {"C=1.0": M.logistic(1.0), "C=5.0": M.logistic(5.0)}
    return M.cross_validate(_corpus(spark, folder), "doc_id", runs)


@query("m4_compare_strengths")
def strengths(spark, folder):
    return E.fold_summary(_strengths(spark, folder), "macro_f1", by=["run"])


@query(
    "m4_folds_of_strengths",
    f"""WITH {SQL_CLASSIFIED}, {SQL_KNOWN}, {SQL_RANKED.replace("FROM cls", "FROM known")}, {SQL_FOLDS},
        supports AS (SELECT fold, count(*) AS support FROM folded GROUP BY fold)
        SELECT run, fold, support, true AS within_bounds FROM supports, (VALUES ('C=1.0'), ('C=5.0')) AS runs(run)""",
)
def folds_of_strengths(spark, folder):
    """Both strengths are scored on every row once, fold by fold, and the scores lie within 0..1."""
    bounds = reduce(lambda a, b: a & b, [F.col(c).between(0, 1) for c in ("accuracy", "macro_f1", "weighted_f1")])
    return _strengths(spark, folder).select("run", "fold", "support", bounds.alias("within_bounds"))


def _same_after_reload(spark, model, df):
    path = scratch_path(spark, "model")
    model.write().save(path)
    before = M.predict(model, df).select("doc_id", "label", F.col("prediction").alias("was"))
    after = M.predict(PipelineModel.load(path), df).select("doc_id", "prediction")
    return before.join(after, "doc_id").select("doc_id", "label", (F.col("was") == F.col("prediction")).alias("same"))


SQL_SAME = f"WITH {SQL_CLASSIFIED}, {SQL_KNOWN} SELECT doc_id, CAST(label AS INTEGER) AS label, true AS same FROM known"


@query("k7_model_round_trip", SQL_SAME)
def round_trip(spark, folder):
    df = _corpus(spark, folder)
    return _same_after_reload(spark, M.fit(df, "doc_id", M.logistic(5.0)), df)


@query("k7_perceptron_round_trip", SQL_SAME)
def perceptron_round_trip(spark, folder):
    df = _corpus(spark, folder)
    return _same_after_reload(spark, M.fit(df, "doc_id", M.perceptron(), M.PERCEPTRON_FEATURES, balanced="copies"), df)
