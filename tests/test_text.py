import re
from functools import reduce

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.functions import labels as L
from labelloom.functions import schema as S
from labelloom.functions import text as T

CLEAN = [
    ("  Dobar  liječnik \n hvala ", "Dobar liječnik hvala"),
    ("see http://q", "see "),
    ("http://x", None),
    ("  ", None),
    (None, None),
    ("http://x <b>", " "),
    ("<b>Super</b> www.a.hr/x !", "Super !"),
    ("a < b and c > d", "a d"),
    ("<a\nb>x", "<a b>x"),
    (" a b ", "a b"),
]


def column(rows, values, schema="v string"):
    return rows([(i, v) for i, v in enumerate(values)], f"i int, {schema}")


def results(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_clean_text_hand_cases(rows):
    df = column(rows, [a for a, _ in CLEAN])
    assert results(df, T.clean_text("v")) == [b for _, b in CLEAN]


# What cleaning replaces, in this order.
RULES = [(r"http\S+|www\S+", ""), ("<.*?>", ""), (r"\s+", " ")]

WILD = st.text(alphabet=list(" \t\n\r\x0b\x1c\x85 　abČđ_9<>/.:wht-p'\"́"), max_size=40)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WILD, min_size=30, max_size=60))
def test_text_functions_match_python_on_any_text(rows, texts):
    df = column(rows, texts)
    assert results(df, T.strip("v")) == [t.strip() for t in texts]
    assert results(df, T.has_text("v")) == [t.strip() != "" for t in texts]
    assert results(df, T.whitespace_tokens("v")) == [t.lower().split() for t in texts]
    assert results(df, T.word_tokens("v")) == [re.findall(r"\b\w\w+\b", t.lower()) for t in texts]

    def clean(t):
        return reduce(lambda out, rule: re.sub(*rule, out), RULES, t.strip()) or None

    assert results(df, T.clean_text("v")) == [clean(t) for t in texts]


def test_clean_minimal(rows):
    assert results(column(rows, [None, " a ", ""]), T.clean_minimal("v")) == ["", "a", ""]


def test_bigrams(rows):
    df = column(rows, ["", "aa", "aa bb", "aa bb cc"])
    got = results(df, T.with_bigrams(T.word_tokens("v")))
    assert got == [[], ["aa"], ["aa", "bb", "aa bb"], ["aa", "bb", "cc", "aa bb", "bb cc"]]


def test_normalize_label(rows):
    words = [" Pozitivno ", "positive", "poz", "2", "neu", "NEG", "0", "neutralno"]
    assert results(column(rows, words), L.normalize_label("v")) == [2, 2, 2, 2, 1, 0, 0, 1]
    assert results(column(rows, ["2.0", "bad", None]), L.normalize_label("v", strict=False)) == [None] * 3


@pytest.mark.parametrize("bad", ["2.0", "bad", None])
def test_normalize_label_raises(rows, bad):
    with pytest.raises(Exception, match="unknown label"):
        column(rows, [bad]).select(L.normalize_label("v")).collect()


def test_int_label_is_lenient_and_truncates(rows):
    df = column(rows, ["1.7", "x", None, "-1.7", "NaN", "Infinity", " 2 "])
    assert results(df, L.int_label("v")) == [1, None, None, -1, None, None, 2]


def test_interpret_kappa(rows):
    values = [-0.01, 0.0, 0.20, 0.21, 0.40, 0.60, 0.61, 0.80, 0.81, None, float("nan")]
    got = results(column(rows, values, "v double"), L.interpret_kappa("v"))
    assert [g.split()[0] for g in got] == [
        "No", "Slight", "Slight", "Fair", "Fair", "Moderate", "Substantial", "Substantial", "Almost", "Undefined", "Undefined",
    ]


def test_argmax_takes_the_first_maximum(rows):
    df = column(rows, [[1.0, 3.0, 3.0], [0.0, 0.0], [5.0]], "v array<double>")
    assert results(df, L.argmax("v")) == [1, 0, 0]


def test_schema_helpers(rows):
    df = rows([("a", 1, 2)], " Text string, LABEL int, sentiment int")
    df = S.normalize_header(df)
    assert df.columns == ["text", "label", "sentiment"]
    found = S.resolve(df, {"text": S.TEXT_NAMES, "label": S.LABEL_NAMES})
    assert found == ({"text": "text", "label": "sentiment"}, {"label": ["label"]})
    assert S.text_and_label(df).collect() == [("a", 2)]
    assert S.drop_stale_labels(df).columns == ["text", "sentiment"]
    with pytest.raises(ValueError, match="missing columns"):
        S.require_columns(df, ["text", "title"])
    with pytest.raises(ValueError, match=r"missing columns \['a', 'b'\].*accepted names {'b': \['x', 'y'\]}"):
        S.resolve(df, {"text": S.TEXT_NAMES, "b": ["x", "y"], "a": ["a"]})
    with pytest.raises(ValueError, match="no rows"):
        S.require_rows(df.filter(F.lit(False)))


def test_text_and_label_drops_incomplete_rows(rows):
    df = rows([("a", 1.0), (None, 1.0), ("b", None)], "review string, labels double")
    assert S.text_and_label(df).collect() == [("a", 1)]
