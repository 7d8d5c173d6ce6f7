import threading

from labelloom.plans import training as M


def test_folds_are_trained_side_by_side(spark):
    data = [(i, f"{'good' if i % 2 else 'bad'} word{i % 7}", i % 2) for i in range(60)]
    corpus = spark.createDataFrame(data, "doc long, text string, label int")
    meet = threading.Barrier(5, timeout=120)

    def build(rows, width):
        meet.wait()
        return M.logistic(1.0, 5).build(rows, width)

    out = M.cross_validate(corpus, "doc", {"x": M.Learner(build)}, M.Features(max_features=40)).collect()
    assert sorted(r["fold"] for r in out) == list(range(5))
