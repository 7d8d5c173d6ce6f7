from itertools import product
from statistics import median

import pytest
from pyspark.sql import functions as F

from labelloom.functions.votes import row_vote, vote_by_group

COLS = ["m", "r1", "r2", "r3"]
LABELS = [None, 0, 1, 2]


def known(votes):
    return [v for v in votes if v is not None]


def vote_neutral(votes):
    own = known(votes)
    return max(set(own), key=lambda v: (own.count(v), v == 1, -own.index(v)), default=None)


def vote_priority(votes):
    own = known(votes)
    support = sorted((own.count(v) for v in set(own)), reverse=True)
    if len(support) > 1 and support[0] == support[1]:
        return votes[0]
    return max(own, key=own.count, default=None)


def vote_median(votes):
    own = known(votes)
    pairs = [v for v in own if own.count(v) > 1]
    return pairs[0] if pairs else int(median(own)) if own else None


def every(rows, width):
    table = list(product(LABELS, repeat=width))
    return table, rows(table, ", ".join(f"{c} int" for c in COLS[:width]))


def test_row_votes_on_every_combination(rows):
    table, df = every(rows, 4)
    got = df.select(
        *COLS, row_vote(COLS, "neutral").alias("a"), row_vote(COLS, "priority", priority="m").alias("b")
    ).collect()
    assert len(got) == len(table)
    for r in got:
        votes = [r[c] for c in COLS]
        assert (r["a"], r["b"]) == (vote_neutral(votes), vote_priority(votes)), votes


def test_median_vote_on_every_combination(rows):
    _, df = every(rows, 3)
    for r in df.select(*COLS[:3], row_vote(COLS[:3], "median").alias("a")).collect():
        assert r["a"] == vote_median([r[c] for c in COLS[:3]]), r


HAND = [
    ((2, 2, 2, 0), 2, 2),
    ((0, 0, 2, 2), 0, 0),
    ((2, 0, 0, 2), 2, 2),
    ((0, 0, 1, 1), 1, 0),
    ((2, 0, 1, 1), 1, 1),
    ((None, 0, 2, 2), 2, 2),
    ((None, 0, 2, None), 0, None),
    ((None, None, None, None), None, None),
]


@pytest.mark.parametrize("votes, neutral, priority", HAND)
def test_row_vote_hand_cases(rows, votes, neutral, priority):
    df = rows([tuple(None if v is None else float(v) for v in votes)], "m double, r1 double, r2 double, r3 double")
    got = df.select(row_vote(COLS, "neutral"), row_vote(COLS, "priority", priority="m")).first()
    assert tuple(got) == (neutral, priority)


def test_strict_priority_raises_on_a_tie_without_the_priority_label(rows):
    df = rows([(None, 0, 2, None)], "m int, r1 int, r2 int, r3 int")
    with pytest.raises(Exception, match="tie without a label"):
        df.select(row_vote(COLS, "priority", priority="m", strict=True)).collect()


def test_unknown_tie_rule():
    with pytest.raises(ValueError):
        row_vote(COLS, "coin")


CASES = [([2, 2, 1, 2], 2), ([0, 1], 1), ([2, 0], 2), ([0, 2], 0), ([2, 0, 0, 2, 1], 2), ([None, None], None), ([3, 3, 0], 3), ([5], 5), ([7, 1, -2, 7, 1], 1)]


def test_group_vote_hand_cases(rows):
    data = [(k, i, v) for k, (votes, _) in enumerate(CASES) for i, v in enumerate(votes)]
    df = rows(data, "k int, i int, v int").repartition(5, "i")
    got = dict(map(tuple, vote_by_group(df, ["k"], "v", "i", "vote").collect()))
    assert got == {k: want for k, (_, want) in enumerate(CASES)}


def test_group_vote_matches_brute_force(rows):
    table = [v for n in (1, 2, 3, 4) for v in product(LABELS, repeat=n)]
    data = [(k, i, v) for k, votes in enumerate(table) for i, v in enumerate(votes)]
    df = rows(data, "k int, i int, v int").repartition(7, F.rand(1))
    got = dict(map(tuple, vote_by_group(df, ["k"], "v", "i", "vote").collect()))
    assert got == {k: vote_neutral(votes) for k, votes in enumerate(table)}


@pytest.mark.parametrize("tie", ["neutral", "priority", "median"])
def test_plans_of_row_votes_stay_small_with_many_raters(rows, tie):
    names = [f"v{i}" for i in range(8)]
    df = rows([(0, 0, 2, 2, 2, 1, 1, 2)], ", ".join(f"{n} string" for n in names))
    sizes = []
    for n in (4, 8):
        out = df.select(row_vote(names[:n], tie, priority="v0").alias("v"))
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[0] < 10_000 and sizes[1] < 2.5 * sizes[0]
    assert out.first()["v"] == 2
