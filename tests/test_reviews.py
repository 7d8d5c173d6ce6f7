import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from labelloom.operators import reviews as R
from labelloom.operators.ordinal import global_ordinal, keep_first, preview
from labelloom.plans import annotation as A
from labelloom.sources.review_text import BODY, END, write_review_text
from labelloom.sources.sinks import write_review_blocks

SENTENCE = "title string, review_id long, sentence_id long, text string, label_m int"


def some_sentences(seed=1, reviews=40, hot=700):
    """Invented sentences; one review holds most of the rows."""
    rng = random.Random(seed)
    out = []
    for i in range(reviews):
        n = hot if i == 7 else rng.randint(1, 6)
        for s in range(1, n + 1):
            text = rng.choice(["a b", " c ", "", "\t", "đ\ne", None])
            out.append((f"T{i % 4}", i // 4 + 1, s, text, rng.choice([0, 1, 2, None])))
    rng.shuffle(out)
    return out


def assemble(data):
    """Brute force: whole reviews in key order."""
    groups = defaultdict(list)
    for title, review, s, text, label in data:
        if text is not None and text.strip():
            groups[(title, review)].append((s, text.strip(), label))
    out = []
    for order, (key, rows) in enumerate(sorted(groups.items()), 1):
        rows.sort(key=lambda r: r[0])
        votes = [r[2] for r in rows if r[2] is not None]
        vote = max(set(votes), key=lambda v: (votes.count(v), v == 1, -votes.index(v)), default=None)
        out.append((order, *key, " ".join(r[1] for r in rows), len(rows), vote))
    return out


@pytest.mark.parametrize("span", [4096, 50, 1])
def test_one_row_per_review(rows, span):
    data = some_sentences()
    got = R.assemble_reviews(rows(data, SENTENCE).repartition(6), span=span)
    assert got.columns == ["review_order", "title", "review_id", "full_review", "number_of_sentences", "label_m_review"]
    assert sorted(map(tuple, got.collect())) == assemble(data)


def test_sentences_without_a_number_stand_last(rows):
    data = [("T", 1, 4096, "b", 3), ("T", 1, 4095, "a", 3), ("T", 1, None, "z", 0), ("T", 2, None, "x", None)]
    got = sorted(map(tuple, R.assemble_reviews(rows(data, SENTENCE)).collect()))
    assert got == [(1, "T", 1, "a b z", 2, 3), (2, "T", 2, "x", 0, None)]


def test_text_export(rows, tmp_path):
    data = [(t, r, s * 1000, x, v) for t, r, s, x, v in some_sentences(hot=120)]
    want = "".join(
        f"REVIEW_ORDER: {o}\nTITLE: {t}\nREVIEW_ID: {r}\nNUMBER_OF_SENTENCES: {n}\nFULL_REVIEW:\n{text}\n{'=' * 80}\n\n"
        for o, t, r, text, n, _ in assemble(data)
    )
    write_review_blocks(R.assemble_reviews(rows(data, SENTENCE)), str(tmp_path / "blocks"))
    got = "".join(f.read_bytes().decode() for f in sorted((tmp_path / "blocks").glob("part-*")))
    assert got == want


def exported(folder):
    parts = [f for sub in (BODY, END) for f in sorted((folder / sub).glob("part-*"))]
    return b"".join(f.read_bytes() for f in parts), len(parts)


@pytest.mark.parametrize("partitions", [1, 7])
def test_text_export_from_sentences(rows, spark, tmp_path, partitions):
    """The same bytes as from whole reviews; the hot review lies in several part files."""
    data = [(t, r, s, x, v) for t, r, s, x, v in some_sentences(hot=400)]
    data += [("A", 1, None, "no number", None), ("A", 1, None, "another", None), ("Z", 9, 1, "line\nbreak ", None), (None, 1, 1, "lost", 1), ("Q", 1, 1, "  ", 1)]
    sentences = rows(data, SENTENCE).repartition(partitions)
    write_review_blocks(R.assemble_reviews(sentences), str(tmp_path / "blocks"))
    want = b"".join(f.read_bytes() for f in sorted((tmp_path / "blocks").glob("part-*")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_review_text(sentences, str(tmp_path / "text"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got, parts = exported(tmp_path / "text")
    assert got == want
    assert parts > 3


def test_text_export_of_little(rows, tmp_path):
    write_review_text(rows([], SENTENCE), str(tmp_path / "none"))
    assert exported(tmp_path / "none")[0] == b""
    write_review_text(rows([("A", 1, 1, " one ", 1)], SENTENCE), str(tmp_path / "one"))
    assert exported(tmp_path / "one")[0].decode() == f"REVIEW_ORDER: 1\nTITLE: A\nREVIEW_ID: 1\nNUMBER_OF_SENTENCES: 1\nFULL_REVIEW:\none\n{'=' * 80}\n\n"


def test_global_ordinal_is_dense_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(9)
    got = global_ordinal(df, ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 5001))


def test_global_ordinal_of_nothing(spark):
    assert global_ordinal(spark.range(0), ["id"]).collect() == []


def test_keep_first_and_preview(rows):
    df = rows([(1, 3, "c"), (1, 2, None), (2, 1, "a"), (1, 5, "b")], "k int, o int, v string").repartition(4)
    assert sorted(map(tuple, keep_first(df, ["k"], ["o"]).collect())) == [(1, 2, None), (2, 1, "a")]
    assert [r["o"] for r in preview(df, ["o"], 2).collect()] == [1, 2]
    assert sorted(map(tuple, keep_first(df.select("k"), ["k"], ["k"]).collect())) == [(1,), (2,)]


def test_review_agreement_takes_first_known_label(rows):
    data = [("T1", 1, 2, None, 2), ("T1", 1, 1, None, 0), ("T1", 1, 3, 2, None), ("T1", 1, 4, 0, 0), (None, 1, 1, 1, 1)]
    df = rows(data, "title string, review_id long, sentence_id long, rater int, label_m int")
    assert R.review_agreement(df, ["rater"]).collect() == [("T1", 1, 0, 2, 4)]


def test_narrow_key_must_be_unique(rows):
    sentences = rows([("T1", 1, 1, "a", 0), ("T2", 1, 1, "b", 0)], SENTENCE)
    reviews = rows([("T1", 1, 2), ("T2", 1, 0)], "title string, review_id long, rater int")
    got = R.spread_labels(sentences, reviews).select("title", "rater").collect()
    assert sorted(map(tuple, got)) == [("T1", 2), ("T2", 0)]
    twice = R.spread_labels(sentences, reviews.drop("title"), ["review_id"])
    with pytest.raises(Exception, match="several label rows"):
        twice.collect()


def test_uniqueness_is_asserted_without_a_job(rows, spark):
    sentences = rows([("T1", 1, 1, "a", 0)] * 3, SENTENCE)
    reviews = rows([("T1", 1, 2, None), ("T2", 1, 0, "x")], "title string, review_id long, rater int, `a.b` string")
    group = "spread-labels"
    spark.sparkContext.setJobGroup(group, group)
    try:
        spread = R.spread_labels(sentences, reviews)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        assert [r["rater"] for r in spread.collect()] == [2] * 3
        assert spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert R.spread_labels(sentences, reviews.select("title", "review_id")).count() == 3


def test_null_keys_match_nothing_and_rows_are_kept(rows):
    sentences = rows([(None, 1, 1, "a", 0), ("T1", 1, 1, "b", 0)], SENTENCE)
    reviews = rows([(None, 1, 2), ("T1", 1, 0)], "title string, review_id long, rater int")
    got = R.spread_labels(sentences, reviews).select("text", "rater").collect()
    assert sorted(map(tuple, got)) == [("a", None), ("b", 0)]
    assert R.unmatched_count(sentences, reviews).first()["unmatched"] == 1


def test_ordinal_labels_follow_first_appearance(rows):
    data = [("T2", 1, 1, 5), ("T1", 1, 1, 6), ("T2", 1, 2, 7), ("T1", 2, 1, 8)]
    df = rows(data, "title string, review_id long, sentence_id long, line long").repartition(3)
    reviews = R.reviews_in_appearance_order(df, ["line"])
    labels = rows([(1, 2), (2, 0), (3, 1)], "review_order long, label int")
    got = A.label_reviews(reviews, {"label_copilot_review": labels})
    assert {(r["title"], r["review_id"]): r["label_copilot_review"] for r in got.collect()} == {
        ("T2", 1): 2,
        ("T1", 1): 0,
        ("T1", 2): 1,
    }
    with pytest.raises(ValueError, match="2 labels for 3 reviews"):
        A.label_reviews(reviews, {"label_copilot_review": labels.filter("review_order < 3")})


def test_distribute_and_final_labels(rows):
    sentences = rows(
        [("T1", 1, 1, "a", 2, 9, 9), ("T1", 1, 2, "b", 0, 9, 9), ("T1", 2, 1, "c", 1, 9, 9)],
        SENTENCE + ", label_perplexity int, label int",
    )
    reviews = rows([("T1", 1, 0, 0, 2)], "title string, review_id long, " + ", ".join(f"{r} int" for r in A.REVIEW_RATERS))
    out = A.distribute_labels(sentences, reviews)
    assert out.columns == ["title", "review_id", "sentence_id", "text", "label_m", *A.REVIEW_RATERS, "label"]
    # 2,0,0,2 is a tie, so the manual label wins; 0,0,0,2 is clear; unlabelled reviews keep the manual label
    assert {r["text"]: r["label"] for r in out.collect()} == {"a": 2, "b": 0, "c": 1}
    final = A.final_labels(out.drop("label"))
    assert all(r["label"] == r["label_final_after_agreement"] for r in final.collect())
    assert sorted(map(tuple, A.final_distribution(out).collect())) == [(0, 1), (1, 1), (2, 1)]


def test_export_reviews_writes_both_files(rows, tmp_path, spark):
    data = some_sentences(hot=3)
    A.export_reviews(rows(data, SENTENCE), str(tmp_path / "t"), str(tmp_path / "b"))
    table = spark.read.csv(str(tmp_path / "t"), header=True, multiLine=True, escape='"')
    assert table.count() == len(assemble(data))
    assert (tmp_path / "b").exists()


def test_clean_sentences_and_corpus(rows):
    raw = rows([(" a <b>", 0.0, 1.0, None), ("http://x", 1.0, 1.0, 1.0), ("c", None, None, None)], " text string, label_m double, label_perplexity double, label_copilot double")
    assert A.clean_sentences(raw).select("text", "label").collect() == [("a ", 0)]
    corpus = rows([("a", "2"), ("b", "3"), ("c", "x"), ("", "1"), ("d", "1.0")], "TEXT string, Label string")
    assert sorted(map(tuple, A.clean_training_corpus(corpus).collect())) == [("a", 2), ("d", 1)]
