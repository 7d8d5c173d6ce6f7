import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.functions.text import whitespace_tokens, with_bigrams, word_tokens
from labelloom.operators import tfidf as W
from labelloom.operators import vocabulary as V


def corpus(seed=3, docs=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [(d, " ".join(rng.choices(words, weights=range(40, 0, -1), k=rng.randint(0, 30)))) for d in range(docs)]


@pytest.fixture
def docs(rows):
    return rows(corpus(), "doc long, text string").repartition(5)


def test_vocabulary_ties_follow_first_occurrence(docs):
    counts = Counter()
    for _, text in corpus():
        counts.update(text.split())
    want = {t: (i + 2, n) for i, (t, n) in enumerate(counts.most_common(25))}
    stats = V.term_statistics(docs, whitespace_tokens("text"), "doc")
    got = {r["token"]: (r["id"], r["count"]) for r in V.top_vocabulary(stats, 25).collect()}
    assert got == want
    assert dict(map(tuple, V.token_counts(docs, whitespace_tokens("text")).collect())) == dict(counts)


def test_term_statistics_by_group(docs):
    tokens = whitespace_tokens("text")
    part = docs.withColumn("fold", F.col("doc") % 3)
    by_fold = V.term_statistics(part, tokens, "doc", by=["fold"])
    summed = by_fold.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    whole = V.term_statistics(docs, tokens, "doc").select("term", "tf", "df")
    assert sorted(summed.collect()) == sorted(whole.collect())


def test_fold_statistics_leave_a_fold_out(docs):
    tokens = whitespace_tokens("text")
    part = docs.withColumn("fold", F.col("doc") % 3)
    stats = V.fold_statistics(part, tokens, "doc", 3).cache()
    whole = V.term_statistics(docs, tokens, "doc").select("term", "tf", "df")
    assert sorted(stats.select("term", "tf", "df").collect()) == sorted(whole.collect())
    for fold in range(3):
        rest = V.term_statistics(part.filter(F.col("fold") != fold), tokens, "doc").select("term", "tf", "df")
        assert sorted(V.without_fold(stats, fold).collect()) == sorted(rest.collect())


def test_encode_hand_cases(rows):
    vocab = rows([("a", 2), ("b", 3)], "token string, id int")
    df = rows([(1, "A b zz"), (2, "a a a a a b"), (3, ""), (4, None)], "doc long, text string")
    got = dict(map(tuple, V.encode(df, whitespace_tokens("text"), vocab, "doc", length=5).collect()))
    assert got == {1: [2, 3, 1, 0, 0], 2: [2, 2, 2, 2, 2], 3: [0] * 5, 4: [0] * 5}


def test_encode_matches_brute_force(docs):
    stats = V.term_statistics(docs, whitespace_tokens("text"), "doc")
    vocabulary = V.top_vocabulary(stats, 12)
    ids = {r["token"]: r["id"] for r in vocabulary.collect()}
    want = {}
    for d, text in corpus():
        codes = [ids.get(t, 1) for t in text.split()][:20]
        want[d] = codes + [0] * (20 - len(codes))
    got = V.encode(docs, whitespace_tokens("text"), vocabulary, "doc", length=20)
    assert dict(map(tuple, got.collect())) == want


@pytest.mark.parametrize("in_row", [True, False])
@pytest.mark.parametrize("sublinear, min_df, size", [(False, 1, 1000), (True, 2, 50)])
def test_tfidf_matches_brute_force(docs, sublinear, min_df, size, in_row, monkeypatch):
    if not in_row:
        monkeypatch.setattr(W, "BROADCAST_ROWS", 0)

    def terms(text):
        words = [w for w in text.split() if len(w) > 1]
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    tf, df = Counter(), Counter()
    for _, text in corpus():
        tf.update(terms(text))
        df.update(set(terms(text)))
    kept = sorted((t for t in tf if df[t] >= min_df), key=lambda t: (-tf[t], t))[:size]
    n = len(corpus())
    want = {}
    for d, text in corpus():
        counts = Counter(t for t in terms(text) if t in set(kept))
        row = {t: ((1 + math.log(c)) if sublinear else c) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in row.values()))
        want.update({(d, t): w / norm for t, w in row.items()})

    tokens = with_bigrams(word_tokens("text"))
    vocabulary = V.feature_vocabulary(V.term_statistics(docs, tokens, "doc"), size, min_df)
    out = W.tfidf(docs, tokens, "doc", W.idf_table(vocabulary, n), size, sublinear).collect()
    got = {(r["doc"], r["term"]): r["weight"] for r in out}
    assert got == pytest.approx(want, abs=1e-12)
    assert {r["term"]: r["idx"] for r in out} == {t: i for i, t in enumerate(sorted(kept)) if any(k[1] == t for k in want)}


def test_term_frequency(rows):
    df = rows([(1, "aa aa bb")], "doc long, text string")
    got = {r["term"]: (r["tf"], r["weight"]) for r in W.term_frequency(df, word_tokens("text"), "doc", True).collect()}
    assert got == {"aa": (2, pytest.approx(1 + math.log(2))), "bb": (1, 1.0)}


def test_tfidf_odd_rows(rows):
    """Texts that are missing, empty or without a known term give no row; repeated ids are rows of their own."""
    df = rows([(1, "aa bb aa"), (1, "aa bb aa"), (2, None), (3, ""), (4, "zz"), (None, "bb")], "doc long, text string")
    idf = rows([("aa", 0, 1, 2.0), ("bb", 1, 1, 1.0)], "term string, idx int, df long, idf double")
    out = W.tfidf(df, word_tokens("text"), "doc", idf, 2).collect()
    norm = math.sqrt(17)
    want = [(1, "aa", 0, 2, 4 / norm), (1, "bb", 1, 1, 1 / norm)] * 2 + [(None, "bb", 1, 1, 1.0)]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert W.tfidf(df, word_tokens("text"), "doc", idf.limit(0), 2).count() == 0


@pytest.mark.parametrize("ties", [["d", "p"], ["term"]])
def test_most_frequent_matches_a_sort(rows, ties, monkeypatch):
    """Every size around the edges of equal frequencies, and frequencies of several digits."""
    monkeypatch.setattr(V, "RADIX_BITS", 3)
    rng = random.Random(4)
    data = [(f"t{i}", rng.choice([1, 1, 1, 2, 7, 8, 9, 64, 500, 2**40, 2**40 + 1]), rng.randint(0, 5), i) for i in range(120)]
    stats = rows(data, "term string, tf long, d long, p long").repartition(4)
    at = {"term": 0, "d": 2, "p": 3}
    ordered = sorted(data, key=lambda r: (-r[1], *[r[at[t]] for t in ties]))
    for size in (1, 2, 20, 57, 58, 75, 119, 120, 500):
        got = {r["term"] for r in V.most_frequent(stats, size, ties).collect()}
        assert got == {r[0] for r in ordered[:size]}, size
    assert V.most_frequent(stats.limit(0), 5, ties).count() == 0


def test_most_frequent_of_one_frequency(rows):
    stats = rows([(f"t{i:03}", 1) for i in range(200)], "term string, tf long").repartition(3)
    assert {r["term"] for r in V.most_frequent(stats, 70, ["term"]).collect()} == {f"t{i:03}" for i in range(70)}
