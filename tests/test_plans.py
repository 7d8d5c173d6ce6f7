"""The shape of physical plans that matters on large data."""

import pytest
from pyspark.sql import functions as F

from labelloom.functions.text import has_text, word_tokens
from labelloom.operators import agreement as G
from labelloom.operators import evaluate as E
from labelloom.operators import reviews as R
from labelloom.operators import tfidf as W
from labelloom.operators import vocabulary as V
from labelloom.plans.annotation import clean_training_corpus

RATERS = ["label_chatgpt_review", "label_perplexity_review", "label_copilot_review"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sentences(spark, tmp_path_factory):
    """A third of all rows belongs to one review."""
    path = str(tmp_path_factory.mktemp("plans") / "sentences")
    hot = F.col("id") % 3 == 0
    (
        spark.range(0, 120_000, 1, 8)
        .select(
            F.when(hot, "T0").otherwise(F.concat(F.lit("T"), F.col("id") % 500)).alias("title"),
            F.when(hot, 1).otherwise((F.col("id") % 1000).cast("long")).alias("review_id"),
            F.col("id").alias("sentence_id"),
            F.concat(F.lit("text number "), F.col("id"), F.repeat(F.lit(" and more"), 5)).alias("text"),
            (F.col("id") % 3).cast("int").alias("label_m"),
            *[(F.col("id") % (i + 2)).cast("int").alias(r) for i, r in enumerate(RATERS)],
        )
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def test_labels_are_spread_by_one_join(spark, sentences):
    reviews = R.review_agreement(sentences, RATERS).select(*R.REVIEW_KEY, *RATERS).filter("title <> 'T7'")
    bare = sentences.drop(*RATERS).unionByName(
        spark.createDataFrame([(None, 1, 1, "x", 0)], sentences.drop(*RATERS).schema)
    )
    got = R.spread_labels(bare, reviews)
    assert plan(got).count("Join ") == 1 and spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert got.count() == bare.count()
    lost = got.filter(F.col(RATERS[0]).isNull())
    assert R.unmatched(bare, reviews).count() == lost.count() == bare.filter("title IS NULL OR title = 'T7'").count()


def test_agreement_reads_only_keys_and_labels_once(sentences):
    reviews = R.review_agreement(sentences, RATERS)
    text = plan(G.agreement_summary(reviews, {"ai": RATERS, "all": ["label_m_review", *RATERS]}))
    assert text.count("FileScan") == 1
    assert "text:string" not in text
    assert "IsNotNull(title)" in text
    assert "Join" not in text


def test_metrics_take_one_scan(sentences):
    df = sentences.select(F.col("label_m").alias("t"), F.col(RATERS[0]).alias("p"))
    for out in (E.scores(df, "t", "p"), E.classification_report(df, "t", "p"), E.confusion_matrix(df, "t", "p")):
        text = plan(out)
        assert text.count("FileScan") == 1 and "Join" not in text


def test_text_is_cleaned_once_per_row(sentences):
    text = plan(clean_training_corpus(sentences.select("text", F.col("label_m").alias("label"))))
    assert text.split("FileScan")[0].count("<[^>") == 1


def test_no_array_travels_with_exploded_terms(sentences):
    stats = V.term_statistics(sentences, word_tokens("text"), "sentence_id")
    text = plan(stats.select("term", "tf", "df"))
    (generate,) = [line for line in text.splitlines() if "Generate" in line]
    assert "_own" not in generate.split("],", 1)[0].split("), [")[-1]
    assert "Filter (size" not in text
    assert text.count("regexp_extract_all") == 1


def test_blank_test_is_cheap_and_pushed_to_the_scan(sentences):
    text = plan(sentences.filter(has_text("text")).select("sentence_id"))
    assert "PushedFilters: [IsNotNull(text)]" in text


def test_term_frequencies_need_no_shuffle(sentences):
    assert "Exchange" not in plan(W.term_frequency(sentences, word_tokens("text"), "sentence_id"))


def test_vocabulary_is_cut_by_a_threshold_not_by_top_rows_of_every_task(sentences):
    stats = V.term_statistics(sentences, word_tokens("text"), "sentence_id")
    for chosen in (V.feature_vocabulary(stats, 100), V.top_vocabulary(stats, 100)):
        assert chosen.count() == 100
        assert not any(limit in plan(chosen) for limit in ("TakeOrdered", "Limit"))


def test_weights_are_worked_out_in_the_row(sentences):
    stats = V.term_statistics(sentences, word_tokens("text"), "sentence_id")
    idf = W.idf_table(V.feature_vocabulary(stats, 100), 120_000)
    text = plan(W.tfidf(sentences, word_tokens("text"), "sentence_id", idf, 100))
    rows = text[: text.index("BroadcastExchange")]
    assert "Exchange" not in rows and "Window" not in rows and "Aggregate" not in rows
    assert text.count("regexp_extract_all") == 1
