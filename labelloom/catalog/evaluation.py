"""Evaluation, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.catalog.entry import query
from labelloom.catalog.inputs import SQL_CLASSIFIED, classified
from labelloom.operators import evaluate as E
from labelloom.operators.split import stratified_folds, stratified_split

METRICS = ("precision", "recall", "f1")

# Per class and data set ({by} names the data set): precision, recall, f1, support.
SQL_CLASSES = """
{cls},
named AS (SELECT {by} AS dataset, label AS t, prediction AS p FROM {source}),
classes AS (SELECT dataset, t AS class FROM named UNION SELECT dataset, p FROM named),
tallied AS (
  SELECT c.dataset, c.class,
         count(*) FILTER (n.t = c.class AND n.p = c.class) AS hit,
         count(*) FILTER (n.p = c.class) AS predicted,
         count(*) FILTER (n.t = c.class) AS support
  FROM classes c JOIN named n ON c.dataset = n.dataset GROUP BY ALL
),
scored AS (
  SELECT dataset, class, hit, support,
         CASE WHEN predicted = 0 THEN 0.0 ELSE hit / CAST(predicted AS DOUBLE) END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE hit / CAST(support AS DOUBLE) END AS recall,
         2.0 * hit / CAST(predicted + support AS DOUBLE) AS f1
  FROM tallied
)
"""


def sql_classes(by: str = "'all'", source: str = "cls", extra: str = "") -> str:
    return SQL_CLASSES.format(cls=SQL_CLASSIFIED + extra, by=by, source=source)


SQL_AVERAGES = ", ".join(
    [f"round(avg({m}), 6) AS macro_{m}" for m in METRICS]
    + [f"round(sum({m} * support) / CAST(sum(support) AS DOUBLE), 6) AS weighted_{m}" for m in METRICS]
)


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "e1_accuracy",
    f"WITH {SQL_CLASSIFIED} SELECT 'all' AS dataset, round(avg(CAST(label = prediction AS INTEGER)), 6) AS accuracy FROM cls",
)
def accuracy(spark, folder):
    return rounded(E.accuracy(classified(spark, folder), "label", "prediction"))


@query(
    "e2_confusion_matrix",
    f"""WITH {sql_classes()} SELECT 'all' AS dataset, a.class AS true_label, b.class AS predicted_label,
          (SELECT count(*) FROM named n WHERE n.t = a.class AND n.p = b.class) AS count FROM classes a, classes b""",
)
def confusion(spark, folder):
    return E.confusion_matrix(classified(spark, folder), "label", "prediction")


@query(
    "e3_macro_f1",
    f"WITH {sql_classes()} SELECT dataset, round(avg(f1), 6) AS macro_f1 FROM scored GROUP BY dataset",
)
def macro_f1(spark, folder):
    return rounded(E.scores(classified(spark, folder), "label", "prediction").select("dataset", "macro_f1"))


WEIGHTED = ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1"]


@query(
    "e4_weighted_scores",
    f"""WITH {sql_classes()} SELECT dataset, round(sum(hit) / CAST(sum(support) AS DOUBLE), 6) AS accuracy,
          {', '.join(f'round(sum({m} * support) / CAST(sum(support) AS DOUBLE), 6) AS weighted_{m}' for m in METRICS)}
        FROM scored GROUP BY dataset""",
)
def weighted(spark, folder):
    return rounded(E.scores(classified(spark, folder), "label", "prediction").select("dataset", *WEIGHTED))


SQL_REPORT = f"""
report AS (
  SELECT dataset, CAST(class AS VARCHAR) AS class, precision, recall, f1, support FROM scored
  UNION ALL
  SELECT dataset, 'accuracy', NULL, NULL, sum(hit) / CAST(sum(support) AS DOUBLE), CAST(sum(support) AS BIGINT) FROM scored GROUP BY dataset
  UNION ALL
  SELECT dataset, 'macro avg', {', '.join(f'avg({m})' for m in METRICS)}, CAST(sum(support) AS BIGINT) FROM scored GROUP BY dataset
  UNION ALL
  SELECT dataset, 'weighted avg', {', '.join(f'sum({m} * support) / CAST(sum(support) AS DOUBLE)' for m in METRICS)},
         CAST(sum(support) AS BIGINT) FROM scored GROUP BY dataset
)
"""


@query(
    "e5_classification_report",
    f"""WITH {sql_classes()}, {SQL_REPORT} SELECT dataset, class, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)}, support FROM report""",
)
def report(spark, folder):
    return rounded(E.classification_report(classified(spark, folder), "label", "prediction"))


@query(
    "e6_scores_by_dataset",
    f"""WITH {sql_classes('lang')} SELECT dataset, CAST(sum(support) AS BIGINT) AS support,
          round(sum(hit) / CAST(sum(support) AS DOUBLE), 6) AS accuracy, {SQL_AVERAGES} FROM scored GROUP BY dataset""",
)
def by_dataset(spark, folder):
    return rounded(E.scores(classified(spark, folder), "label", "prediction", "lang"))


@query("k5_prediction_table", f"WITH {SQL_CLASSIFIED} SELECT text, prediction AS prediction_label, label AS truth_label FROM cls")
def predictions(spark, folder):
    return E.prediction_table(classified(spark, folder), "text", "label", "prediction")


@query(
    "k5_prediction_table_correct",
    f"WITH {SQL_CLASSIFIED} SELECT text, label AS true_label, prediction AS predicted_label, label = prediction AS correct FROM cls",
)
def predictions_correct(spark, folder):
    return E.prediction_table(classified(spark, folder), "text", "label", "prediction", correct=True)


# Quotas by whole shares and largest remainders, then ranks in hash order.
SQL_RANKED = """
ranked AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS r FROM cls
),
sizes AS (
  SELECT label, n, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(sum(n) OVER (ORDER BY label) - n AS BIGINT) AS start
  FROM (SELECT label, count(*) AS n FROM cls GROUP BY label)
)
"""

SQL_HOLDOUT = """
held AS (SELECT *, CAST(ceil(total * 0.25::DOUBLE) AS BIGINT) AS n_held FROM sizes),
t1 AS (SELECT *, n * (total - n_held) // total AS whole, n * (total - n_held) % total AS rem FROM held),
t2 AS (SELECT *, whole + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= total - n_held - sum(whole) OVER () THEN 1 ELSE 0 END AS train FROM t1),
v1 AS (SELECT *, n - train AS rest, n_held - CAST(ceil(n_held * 0.8::DOUBLE) AS BIGINT) AS n_val FROM t2),
v2 AS (SELECT *, rest * n_val // n_held AS vwhole, rest * n_val % n_held AS vrem FROM v1),
quotas AS (SELECT *, vwhole + CASE WHEN row_number() OVER (ORDER BY vrem DESC, label) <= n_val - sum(vwhole) OVER () THEN 1 ELSE 0 END AS val FROM v2),
placed AS (
  SELECT doc_id, label, CASE WHEN r <= train THEN 'train' WHEN r <= train + val THEN 'val' ELSE 'test' END AS split
  FROM ranked JOIN quotas USING (label)
)
"""


@query("w4_stratified_split", f"WITH {SQL_CLASSIFIED}, {SQL_RANKED}, {SQL_HOLDOUT} SELECT * FROM placed")
def split(spark, folder):
    return stratified_split(classified(spark, folder).select("doc_id", "label"), "label", "doc_id")


SQL_FOLDS = """
shares AS (
  SELECT label, fold, CASE WHEN j >= n THEN 0 ELSE (n - 1 - j) // 5 + 1 END AS quota
  FROM (SELECT label, n, f AS fold, ((f - start) % 5 + 5) % 5 AS j FROM sizes, range(5) AS folds(f))
),
upto AS (SELECT label, fold, quota, sum(quota) OVER (PARTITION BY label ORDER BY fold) AS last FROM shares),
folded AS (
  SELECT r.doc_id, r.label, CAST(u.fold AS INTEGER) AS fold FROM ranked r JOIN upto u
  ON r.label = u.label AND r.r <= u.last AND r.r > u.last - u.quota
)
"""


@query("w5_stratified_folds", f"WITH {SQL_CLASSIFIED}, {SQL_RANKED}, {SQL_FOLDS} SELECT * FROM folded")
def folds(spark, folder):
    return stratified_folds(classified(spark, folder).select("doc_id", "label"), "label", "doc_id")


@query(
    "a13_fold_summary",
    f"""WITH {SQL_CLASSIFIED}, {SQL_RANKED}, {SQL_FOLDS},
        acc AS (SELECT fold, avg(CAST(cls.label = prediction AS INTEGER)) AS score FROM folded JOIN cls USING (doc_id) GROUP BY fold)
        SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM acc""",
)
def fold_summary(spark, folder):
    df = classified(spark, folder).select("doc_id", "label", "prediction")
    scores = E.accuracy(stratified_folds(df, "label", "doc_id"), "label", "prediction", "fold")
    return rounded(E.fold_summary(scores, "accuracy"))


@query(
    "m6_best_run",
    f"""WITH {sql_classes('source')} SELECT dataset, round(sum(f1 * support) / CAST(sum(support) AS DOUBLE), 6) AS weighted_f1
        FROM scored GROUP BY dataset ORDER BY sum(f1 * support) / CAST(sum(support) AS DOUBLE) DESC, dataset LIMIT 1""",
)
def best(spark, folder):
    runs = E.scores(classified(spark, folder), "label", "prediction", "source").select("dataset", "weighted_f1")
    return rounded(E.best_run(runs, "weighted_f1", "dataset"))
