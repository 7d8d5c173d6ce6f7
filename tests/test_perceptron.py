import random

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelloom.plans import perceptron as P
from labelloom.plans.perceptron import Block, SparsePerceptron, minimise, unpacked

LAYERS = [40, 6, 5, 3]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        held = sorted(rng.sample(range(LAYERS[0]), rng.randint(0, 6)))
        vector = Vectors.sparse(LAYERS[0], held, [rng.uniform(0.1, 1.0) for _ in held])
        rows.append((i, float(i % 3), vector if i % 4 else Vectors.dense(vector.toArray())))
    return spark.createDataFrame(rows, ["id", "label", "features"]).cache()


def weights(rows, iterations=12):
    return SparsePerceptron(LAYERS, iterations, 42).fit(rows).weights.toArray()


@pytest.mark.parametrize("parts", [1, 3])
def test_sparse_rows_teach_what_mllib_learns_from_dense_ones(points, parts):
    """300 rows: full blocks and shorter ones."""
    many = points.unionAll(points).unionAll(points).unionAll(points.limit(30)).repartition(parts, "id").cache()
    mllib = MultilayerPerceptronClassifier(layers=LAYERS, maxIter=12, seed=42).fit(many)
    assert weights(many) == pytest.approx(mllib.weights.toArray(), abs=1e-5)


def test_a_block_holds_its_own_columns_only():
    """A pass costs what the rows hold: of a million features the block multiplies two."""
    sizes = [1_000_000, 2, 3]
    flat = np.linspace(-1.0, 1.0, 2_000_000 + 2 + 6 + 3)
    block = Block.of(np.array([0, 2]), np.array([2, 1]), np.array([7, 999_999, 7]), np.array([0.5, 1.0, 2.0]))
    assert block.columns.tolist() == [7, 999_999]
    slope = np.zeros(len(flat))
    loss = block.add_loss(unpacked(flat, sizes), unpacked(slope, sizes))
    assert set(np.flatnonzero(slope[:2_000_000]) // 2) == {7, 999_999}
    for k in (14, 1_999_999, 2_000_001, 2_000_005, 2_000_010):
        near = flat.copy()
        near[k] += 1e-6
        assert (block.add_loss(unpacked(near, sizes), unpacked(np.zeros(len(flat)), sizes)) - loss) / 1e-6 == pytest.approx(slope[k], abs=1e-4)


def test_wrong_labels_are_refused(points):
    with pytest.raises(Exception, match="labels must be 0..2"):
        weights(points.withColumn("label", F.lit(3.0)))


def test_steps_end_at_the_least_value():
    scale = np.array([1.0, 10.0, 100.0])
    found = minimise(lambda x: (float(scale @ (x - 1) ** 2) + 1.0, 2 * scale * (x - 1)), np.zeros(3), 100, 1e-9)
    assert found == pytest.approx(np.ones(3), abs=1e-3)


def test_thick_and_thin_columns_give_the_loss_of_a_dense_matrix():
    """Columns that most rows hold, columns that a few hold, columns of one row, empty rows and weights."""
    rng = np.random.default_rng(4)
    sizes, n = [300, 7, 4, 3], 400
    held = rng.random((n, sizes[0])) < np.r_[np.full(5, 0.7), np.full(95, 0.02), np.full(200, 0.002)]
    held[::9] = False
    matrix = np.where(held, rng.uniform(0.1, 1.0, held.shape), 0.0)
    row, column = np.nonzero(held)
    label, weight = rng.integers(0, 3, n), rng.uniform(0.1, 2.0, n)
    block = Block.of(label, np.bincount(row, minlength=n), column, matrix[row, column], weight)
    assert 0 < len(block.entries.thick) < len(block.columns) == held.any(axis=0).sum()
    flat = rng.normal(size=sum((a + 1) * b for a, b in zip(sizes, sizes[1:])))
    layers, slope = unpacked(flat, sizes), np.zeros(len(flat))
    loss = block.add_loss(layers, unpacked(slope, sizes))

    outs = [matrix]
    for k, (w, b) in enumerate(layers):
        z = outs[-1] @ w + b
        outs.append(1 / (1 + np.exp(-z)) if k < 2 else np.exp(z) / np.exp(z).sum(axis=1, keepdims=True))
    assert loss == pytest.approx(-weight @ np.log(outs[-1][np.arange(n), label]))
    off = (outs[-1] - np.eye(3)[label]) * weight[:, None]
    for k in (2, 1, 0):
        dw, db = unpacked(slope, sizes)[k]
        assert dw == pytest.approx(outs[k].T @ off, abs=1e-9) and db == pytest.approx(off.sum(axis=0), abs=1e-9)
        off = (off @ layers[k][0].T) * outs[k] * (1 - outs[k])


def _rows(points):
    column, value = P.sparse()
    return points.select(F.col("label").cast("long").alias("label"), column.alias("column"), value.alias("value"))


def test_copies_of_a_row_are_one_row_with_their_weight(points):
    """A pass reads each of the rows that balancing repeats once; stacks of 128 rows weigh alike."""
    many = points.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5)))).repartition(4, "copy", "id")
    sizes = many.groupBy(F.spark_partition_id()).count().collect()
    blocks = P._blocks(_rows(many), 3).collect()
    distinct = points.select("label", F.col("features").cast("string")).distinct().count()
    assert sum(len(b.label) for b in blocks) == distinct < 450
    assert sum(b.weight.sum() for b in blocks) == pytest.approx(sum(-(-r["count"] // 128) for r in sizes))


def test_a_pass_moves_a_gradient_for_each_core_however_many_partitions(spark, points):
    context = spark.sparkContext
    blocks = P._blocks(_rows(points), 3).repartition(40).persist()
    blocks.count()
    evaluate = P._slopes(blocks, LAYERS)
    context.setJobGroup("one pass", "one pass")
    try:
        evaluate(np.zeros(sum((a + 1) * b for a, b in zip(LAYERS, LAYERS[1:]))))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    (job,) = tracker.getJobIdsForGroup("one pass")
    stages = [tracker.getStageInfo(k).numTasks for k in tracker.getJobInfo(job).stageIds]
    assert max(stages) <= context.defaultParallelism < 40
    blocks.unpersist()


def test_predictions_from_entries_are_mllibs(points):
    model = SparsePerceptron(LAYERS, 12, 42).fit(points)
    both = model.transform(points).withColumn("own", P.prediction(model))
    assert both.filter("own <> prediction").isEmpty() and both.select("own").distinct().count() > 1
