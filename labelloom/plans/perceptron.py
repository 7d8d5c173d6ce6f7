"""MLlib's perceptron, learnt from sparse rows.

MLlib's trainer copies rows into dense matrices of all features. Here equal rows are one row with their
weight, and a block of rows keeps its entries: columns that many of its rows hold are a matrix, made anew
in each pass, the others are summed entry by entry. Rows stay in the tasks; a pass sends the weights out
and adds up the gradient in as many slices as there are cores. The loss (mean over stacks of 128 rows of a
partition, short ones too, of their mean cross entropy; sigmoid units, soft-max on top), the random start,
the steps (L-BFGS, strong Wolfe conditions) and the model are MLlib's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, SparkContext, StorageLevel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.products import Entries, blocks_of, entries
from labelloom.plans.passes import Evaluate, minimise, shares, summed
from labelloom.threads import one_thread

#: Rows of a stack, MLlib's block; the last one of a partition may have fewer.
ROWS = 128

Layers = list[tuple[np.ndarray, np.ndarray]]


def _forward(z: np.ndarray, layers: Layers) -> tuple[list[np.ndarray], np.ndarray]:
    """What each hidden layer gives, and the sums of the last layer, from those of the first."""
    held = []
    for w, b in layers[1:]:
        held.append(1.0 / (1.0 + np.exp(-z)))
        z = held[-1] @ w + b
    return held, z


@dataclass
class Block:
    """Weighted rows as entries over the columns that they hold."""

    label: np.ndarray
    weight: np.ndarray
    entries: Entries

    @staticmethod
    def of(label: np.ndarray, sizes: np.ndarray, column: np.ndarray, value: np.ndarray, weight: np.ndarray | None = None) -> Block:
        """Without a ``weight`` rows share a weight of one."""
        weight = np.full(len(label), 1.0 / max(len(label), 1)) if weight is None else weight
        return Block(label, weight, Entries.of(sizes, column, value))

    @property
    def columns(self) -> np.ndarray:
        return self.entries.columns

    def add_loss(self, layers: Layers, slopes: Layers) -> float:
        """The weighted loss of the rows; its slopes are added to ``slopes``."""
        weights, bias = layers[0]
        matrix = self.entries.matrix()
        held, z = _forward(self.entries.times(weights, matrix) + bias, layers)
        z -= z.max(axis=1, keepdims=True)
        log_chance = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        own = np.arange(len(self.label)), self.label
        off = np.exp(log_chance)
        off[own] -= 1.0
        off *= self.weight[:, None]
        for (w, _), (dw, db), out in zip(layers[:0:-1], slopes[:0:-1], held[::-1], strict=True):
            dw += out.T @ off
            db += off.sum(axis=0)
            off = (off @ w.T) * out * (1.0 - out)
        dw, db = slopes[0]
        self.entries.add_turned(dw, off, matrix)
        db += off.sum(axis=0)
        return -float(log_chance[own] @ self.weight)


def unpacked(flat: np.ndarray, sizes: Sequence[int]) -> Layers:
    """(weights, bias) of each layer, as views of MLlib's flat vector."""
    layers, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return layers


def _stacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition, ``ROWS`` at a time."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pa.concat_batches([rest, batch])
        whole = len(rest) // ROWS * ROWS
        yield from (rest.slice(a, ROWS) for a in range(0, whole, ROWS))
        rest = rest.slice(whole)
    if rest is not None and len(rest):
        yield rest


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their weight in the loss, a stack's rows one together."""
    for rows in _stacks(batches):
        yield rows.append_column("weight", pa.array(np.full(len(rows), 1.0 / len(rows))))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, size, column, value, weight) of each block of rows, as bytes."""
    for batch in batches:
        for rows in blocks_of(batch):
            label = rows["label"].to_numpy(zero_copy_only=False).astype(np.int64)
            arrays = (label, *entries(rows), rows["weight"].to_numpy())
            yield pa.RecordBatch.from_pydict({f"a{k}": pa.array([x.tobytes()], pa.binary()) for k, x in enumerate(arrays)})


def _blocks(rows: DataFrame, classes: int) -> RDD:
    """The rows as blocks. Rows weigh by the stack of their partition that they are in; equal rows, of
    whatever partitions, are one with the sum of their weights."""
    kinds = (np.int64, np.int64, np.int64, np.float64, np.float64)

    def block(row) -> Block:
        arrays = [np.frombuffer(x, dtype=kind) for x, kind in zip(row, kinds, strict=True)]
        if ((arrays[0] < 0) | (arrays[0] >= classes)).any():
            raise ValueError(f"labels must be 0..{classes - 1}")
        return Block.of(*arrays)

    weighed = rows.mapInArrow(_weighed, "label long, column array<int>, value array<double>, weight double")
    distinct = weighed.groupBy("label", "column", "value").agg(F.sum("weight").alias("weight"))
    return distinct.mapInArrow(_arrays, ", ".join(f"a{k} binary" for k in range(len(kinds)))).rdd.map(block)


def _slopes(blocks: RDD, sizes: Sequence[int]) -> Evaluate:
    """Mean loss of the rows and its gradient, one job a call."""
    own = shares(blocks)

    def evaluate(flat: np.ndarray) -> tuple[float, np.ndarray]:
        sent = blocks.context.broadcast(flat)

        def work(blocks: Iterator[Block]) -> np.ndarray:
            out = np.zeros(len(sent.value) + 2)
            layers, into = unpacked(sent.value, sizes), unpacked(out, sizes)
            for block in blocks:
                out[-2] += block.add_loss(layers, into)
                out[-1] += block.weight.sum()
            return out

        try:
            total = summed(own, len(flat) + 2, work)
        finally:
            sent.destroy()
        total[:-1] /= total[-1]
        return float(total[-2]), total[:-2]

    return evaluate


def sparse(features: str = "features") -> tuple[Column, Column]:
    """(indices, values) of a vector; of a dense one all are listed."""
    vector = F.unwrap_udt(features)
    every = F.sequence(F.lit(0), F.size(vector["values"]) - 1)
    return F.coalesce(vector["indices"], F.when(F.size(vector["values"]) > 0, every)), vector["values"]


def prediction(model: MultilayerPerceptronClassificationModel, features: str = "features") -> Column:
    """The model's prediction from the entries that a row holds; MLlib makes each row dense."""
    sizes = model.getLayers()
    sent = SparkContext.getOrCreate().broadcast(model.weights.toArray())

    @F.arrow_udf("double")
    def best(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        one_thread()
        layers = unpacked(sent.value, sizes)
        weights, bias = layers[0]
        for columns, values in batches:
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(columns), 0).to_numpy(zero_copy_only=False))]
            column, value = columns.flatten().to_numpy(), values.flatten().to_numpy()
            z = np.tile(bias, (len(columns), 1))
            for row, (a, b) in enumerate(zip(ends, ends[1:])):
                z[row] += value[a:b] @ weights.take(column[a:b], axis=0)
            yield pa.array(_forward(z, layers)[1].argmax(axis=1).astype(np.float64))

    return best(*sparse(features))


class SparsePerceptron(Estimator):
    """Learns (features, label) as ``MultilayerPerceptronClassifier`` does and gives its model.

    As there, a stack that is not full weighs as much as a full one.
    """

    def __init__(self, layers: Sequence[int], iterations: int, seed: int, tolerance: float = 1e-6):
        super().__init__()
        self.layers, self.iterations, self.seed, self.tolerance = list(layers), iterations, seed, tolerance

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        column, value = sparse()
        rows = dataset.select(F.col("label").cast("long").alias("label"), column.alias("column"), value.alias("value"))
        blocks = _blocks(rows, self.layers[-1]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            blocks.count()
            start = self._model(dataset, None).weights.toArray()
            found = minimise(_slopes(blocks, self.layers), start, self.iterations, self.tolerance)
        finally:
            blocks.unpersist()
        return self._model(dataset, found)

    def _model(self, dataset: DataFrame, weights: np.ndarray | None) -> MultilayerPerceptronClassificationModel:
        """MLlib's model with the given weights, or with those it starts from: it is fitted for no iteration."""
        shell = MultilayerPerceptronClassifier(layers=self.layers, maxIter=0, seed=self.seed)
        if weights is not None:
            shell.setInitialWeights(Vectors.dense(weights))
        blank = [(0.0, Vectors.sparse(self.layers[0], [], []))]
        model = shell.fit(dataset.sparkSession.createDataFrame(blank, ["label", "features"]))
        # else the weights would be written once more, as text, with the model's settings
        model.clear(model.initialWeights)
        return model
