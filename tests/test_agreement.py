import pytest
from pyspark.sql import functions as F

from labelloom.operators import agreement as G
from labelloom.operators import distribution as D

# Published agreement study: how many of its 139 reviews got each combination of labels
# (manual vote, then three raters).
PATTERNS = {
    "0210": 1, "0212": 1, "0221": 3, "0222": 14, "1000": 1, "1001": 2, "1002": 4, "1010": 1, "1020": 1,
    "1022": 1, "1111": 1, "1202": 1, "1210": 1, "1211": 1, "1212": 1, "1220": 2, "1221": 6, "1222": 17,
    "2000": 1, "2001": 3, "2002": 1, "2010": 3, "2011": 7, "2021": 1, "2100": 1, "2101": 1, "2110": 2,
    "2111": 2, "2121": 2, "2201": 1, "2211": 3, "2212": 1, "2221": 8, "2222": 43,
}
RATERS = ["m", "a", "b", "c"]


@pytest.fixture
def study(rows):
    data = [tuple(map(int, p)) for p, n in PATTERNS.items() for _ in range(n)]
    return rows([(i, *d) for i, d in enumerate(data)], "item int, m int, a int, b int, c int").repartition(6)


def test_published_kappas(study):
    got = {r["comparison"]: r for r in G.fleiss_kappa(study, {"ai": RATERS[1:], "all": RATERS}).collect()}
    assert got["ai"]["samples"] == got["all"]["samples"] == 139
    assert got["ai"]["categories"] == [0, 1, 2]
    assert got["ai"]["observed"] == pytest.approx(0.7026378896882484, abs=1e-12)
    assert got["ai"]["chance"] == pytest.approx(0.5207747471087877, abs=1e-12)
    assert got["ai"]["kappa"] == pytest.approx(0.37949407190514844, abs=1e-12)
    assert got["all"]["kappa"] == pytest.approx(0.12508155824217926, abs=1e-12)


def test_published_summary(study):
    got = G.agreement_summary(study, {"ai": RATERS[1:], "all": RATERS}).orderBy("comparison").collect()
    assert list(map(tuple, got)) == [
        ("ai", "review", 139, 0.3795, "Fair agreement"),
        ("all", "review", 139, 0.1251, "Slight agreement"),
    ]


def test_published_label_counts(study):
    want = {"m": [19, 40, 80], "a": [26, 9, 104], "b": [16, 25, 98], "c": [14, 41, 84]}
    for column, counts in want.items():
        got = dict(map(tuple, D.label_distribution(study, column).collect()))
        assert [got[k] for k in (0, 1, 2)] == counts


def test_rating_matrix(rows):
    df = rows([(1, 0, 0, 2), (2, 1, 1, 1), (3, None, 1, 1)], "item int, a int, b int, c int")
    got = sorted(map(tuple, G.rating_matrix(df, ["item"], ["a", "b", "c"]).collect()))
    assert got == [(1, 0, 2), (1, 2, 1), (2, 1, 3)]


def test_kappa_without_chance_disagreement_is_undefined(rows):
    df = rows([(1, 1), (1, 1)], "a int, b int")
    row = G.fleiss_kappa(df, {"x": ["a", "b"]}).first()
    assert row["kappa"] is None and row["interpretation"] == "Undefined"


def test_kappa_needs_complete_rows(rows):
    df = rows([(1, None), (None, 1)], "a int, b int")
    assert G.fleiss_kappa(df, {"x": ["a", "b"]}).collect() == []
    with pytest.raises(ValueError, match="no rows"):
        G.fleiss_kappa(df, {"x": ["a", "b"]}, strict=True)
    with pytest.raises(ValueError, match="missing columns"):
        G.fleiss_kappa(df, {"x": ["a", "z"]})


def test_distribution_lists_absent_classes(rows):
    df = rows([(0,), (0,), (None,), (7,)], "label int")
    assert sorted(map(tuple, D.label_distribution(df).collect())) == [(0, 2), (1, 0), (2, 0), (7, 1)]
    assert sorted(map(tuple, D.label_distribution(df, classes=None).collect())) == [(0, 2), (7, 1)]


def test_class_weights(rows):
    df = rows([(0,)] * 1 + [(1,)] * 3 + [(2,)] * 6, "label int")
    got = {r["label"]: r["weight"] for r in D.class_weights(df).collect()}
    assert got == pytest.approx({0: 10 / 3, 1: 10 / 9, 2: 10 / 18})
    assert D.with_class_weights(df).agg({"weight": "sum"}).first()[0] == pytest.approx(10)


def test_class_weights_of_a_million_classes(spark):
    df = spark.range(1_500_000).select((F.col("id") % 1_000_000).alias("label"))
    weights = D.class_weights(df)
    assert "collect_list" not in weights._jdf.queryExecution().toString()
    got = weights.agg(F.count("*").alias("n"), F.sum(F.col("weight") * F.col("count")).alias("w"), F.max("weight").alias("top")).first()
    assert (got["n"], round(got["w"]), got["top"]) == (1_000_000, 1_500_000, 1.5)
    assert D.with_class_weights(df).agg(F.sum("weight")).first()[0] == pytest.approx(1_500_000)


def test_unreadable_labels_are_left_out_alike(rows):
    """One rule for the rating matrix and for kappa: every rater must have given a number."""
    df = rows([(1, "0", "0"), (2, "1", "x"), (3, None, "1"), (4, "2", "1")], "item int, a string, b string")
    matrix = {(r["item"], r["category"]): r["votes"] for r in G.rating_matrix(df, ["item"], ["a", "b"]).collect()}
    assert matrix == {(1, 0): 2, (4, 2): 1, (4, 1): 1}
    assert G.fleiss_kappa(df, {"both": ["a", "b"]}).first()["samples"] == 2
