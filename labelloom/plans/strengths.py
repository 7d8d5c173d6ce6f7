"""Logistic fits of several folds and strengths, side by side over one table of counts.

A row's vector in a fold is its counts times the fold's frequencies, at unit length. Each pass reads the
counts once and gives every fit that goes on its loss and slope, where a fit alone would read vectors of
its own. Loss, scaling of the features, start and steps are those of MLlib's multinomial regression with an
intercept and without ``standardization``: it steps in centred features of unit variance and takes the
penalty of the unscaled ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.products import Entries, blocks_of, entries
from labelloom.plans.passes import minimise_all, shares, steps_of, summed
from labelloom.threads import one_thread

#: A feature whose variance is less than this share of its squared mean does not vary: that is rounding.
STILL = 1e-12


@dataclass(frozen=True)
class Strength:
    """A fit's inverse penalty ``c``, its steps at most, and when it ends."""

    c: float
    iterations: int
    tolerance: float


@dataclass
class Block:
    """Rows of counts, and one over the length of each row's vector in each fold."""

    label: np.ndarray
    fold: np.ndarray
    entries: Entries
    shrink: np.ndarray


def _shrink(held: Entries, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """One over the Euclidean length of the rows in each fold; none for rows without a term there."""
    square = held.squares(idf * idf, matrix)
    return np.divide(1.0, np.sqrt(square), out=np.zeros_like(square), where=square > 0)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in blocks_of(batch):
            arrays = (rows["label"].to_numpy().astype(np.int64), rows["fold"].to_numpy().astype(np.int64), *entries(rows))
            yield pa.RecordBatch.from_pydict({f"a{k}": pa.array([x.tobytes()], pa.binary()) for k, x in enumerate(arrays)})


def _blocks(rows: DataFrame, idf: np.ndarray) -> RDD:
    kinds = (np.int64, np.int64, np.int64, np.int64, np.float64)
    sent = rows.sparkSession.sparkContext.broadcast(idf)

    def block(row) -> Block:
        label, fold, *held = [np.frombuffer(x, dtype=kind) for x, kind in zip(row, kinds, strict=True)]
        held = Entries.of(*held)
        return Block(label, fold, held, _shrink(held, sent.value, held.matrix()))

    return rows.mapInArrow(_arrays, ", ".join(f"a{k} binary" for k in range(len(kinds)))).rdd.map(block)


def _moments(own: RDD, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, sum of squares) of each feature over the rows that each fold learns from."""
    terms, folds = idf.shape

    def work(blocks: Iterator[Block]) -> np.ndarray:
        out = np.zeros((2, terms, folds))
        for b in blocks:
            shrink = np.where(b.fold[:, None] != np.arange(folds), b.shrink, 0.0)
            matrix = b.entries.matrix()
            for power in (1, 2):
                b.entries.add_turned(out[power - 1], shrink**power, matrix, power)
        return out.ravel()

    total = summed(own, 2 * terms * folds, work).reshape(2, terms, folds)
    return total[0] * idf, total[1] * idf * idf


def _losses(b: Block, weights: np.ndarray, bias: np.ndarray, folds: np.ndarray, out: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The loss of each fit; slopes are added to ``out`` and, those of the bias, to ``offs``.

    ``weights`` has a column for each class and fit, ``bias`` a row for each class, ``folds`` the fold that
    each fit leaves out.
    """
    classes, fits = bias.shape
    matrix, shrink = b.entries.matrix(), b.shrink[:, folds]
    z = b.entries.times(weights, matrix).reshape(-1, classes, fits) * shrink[:, None] + bias
    each = [z[:, k] for k in range(classes)]
    top = each[0]
    for x in each[1:]:
        top = np.maximum(top, x)
    chance = np.exp(z - top[:, None])
    whole = sum(chance[:, k] for k in range(classes))
    learnt = b.fold[:, None] != folds
    at = np.arange(len(b.label)), b.label
    loss = np.where(learnt, np.log(whole) + top - z[at], 0.0).sum(axis=0)
    chance /= whole[:, None]
    chance[at] -= 1.0
    chance *= learnt[:, None]
    offs += chance.sum(axis=0)
    chance *= shrink[:, None]
    b.entries.add_turned(out, chance.reshape(len(b.label), -1), matrix)
    return loss


def _pass(own: RDD, weights: np.ndarray, bias: np.ndarray, folds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, slopes of the weights, slopes of the bias) of all fits, summed over the rows that they learn from."""
    classes, fits = bias.shape
    sent = own.context.broadcast((weights, bias, folds))

    def work(blocks: Iterator[Block]) -> np.ndarray:
        weights, bias, folds = sent.value
        out, offs, loss = np.zeros(weights.shape), np.zeros(bias.shape), np.zeros(fits)
        for block in blocks:
            loss += _losses(block, weights, bias, folds, out, offs)
        return np.concatenate([loss, offs.ravel(), out.ravel()])

    try:
        total = summed(own, fits + bias.size + weights.size, work)
    finally:
        sent.destroy()
    loss, offs, out = np.split(total, [fits, fits + bias.size])
    return loss, out.reshape(weights.shape), offs.reshape(bias.shape)


class _Fit:
    """One fit in MLlib's scaled features: parameters are a matrix (term, class) with the intercepts last."""

    def __init__(self, strength: Strength, sizes: np.ndarray, idf: np.ndarray, sums: np.ndarray, squares: np.ndarray, rows: int):
        self.idf, self.weight = idf, sizes.sum()
        mean = sums / self.weight
        variance = (squares - self.weight * mean * mean) / max(self.weight - 1, 1)
        moves = variance > STILL * mean * mean
        self.per_std = np.divide(1.0, np.sqrt(np.where(moves, variance, 1.0)), out=np.zeros_like(mean), where=moves)
        self.scaled_mean = mean * self.per_std
        self.penalty = self.per_std**2 / (strength.c * rows)
        # MLlib counts the classes up to the largest label that it is given
        self.classes, self.room = int(np.flatnonzero(sizes).max()) + 1, len(sizes)
        self.constant = int(sizes.argmax()) if (sizes > 0).sum() == 1 else None
        start = np.zeros((len(idf) + 1, self.classes))
        start[-1] = np.log1p(sizes[: self.classes])
        start[-1] -= start[-1].mean()
        self.steps = steps_of(start.ravel(), strength.iterations, strength.tolerance)

    def spread(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights of counts, bias), with classes that the fit does not know at no chance."""
        own = x.reshape(-1, self.classes)
        weights, bias = np.zeros((len(self.idf), self.room)), np.full(self.room, -np.inf)
        weights[:, : self.classes] = own[:-1] * (self.per_std * self.idf)[:, None]
        bias[: self.classes] = own[-1] - self.scaled_mean @ own[:-1]
        return weights, bias

    def value(self, x: np.ndarray, loss: float, out: np.ndarray, offs: np.ndarray) -> tuple[float, np.ndarray]:
        """The penalised mean loss at ``x`` and its slope, from sums over the rows."""
        own = x.reshape(-1, self.classes)
        out, offs = out[:, : self.classes], offs[: self.classes]
        slope = np.empty_like(own)
        slope[:-1] = (out * (self.per_std * self.idf)[:, None] - np.outer(self.scaled_mean, offs)) / self.weight
        slope[-1] = offs / self.weight
        pull = own[:-1] * self.penalty[:, None]
        slope[:-1] += pull
        return float(loss / self.weight + 0.5 * np.vdot(own[:-1], pull)), slope.ravel()

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """What ``spread`` gives for a fit whose rows are all of one class."""
        bias = np.full(self.room, -np.inf)
        bias[self.constant] = 0.0
        return np.zeros((len(self.idf), self.room)), bias


def _models(rows: DataFrame, idf: np.ndarray, runs: Sequence[Strength], documents: Mapping[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of every fold and run, as (term, class, fold, run) and (class, fold, run)."""
    sizes: dict[tuple[int, int], int] = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    labels = [label for _, label in sizes]
    if min(labels) < 0:
        raise ValueError("labels must not be negative")
    terms, folds = idf.shape
    known = np.zeros((folds, max(labels) + 1))
    for (fold, label), n in sizes.items():
        known[np.arange(folds) != fold, label] += n
    blocks = _blocks(rows, idf).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        blocks.count()
        own = shares(blocks)
        sums, squares = _moments(own, idf)
        fits = {
            (f, k): _Fit(run, known[f], idf[:, f], sums[:, f], squares[:, f], documents[f]) for f in range(folds) for k, run in enumerate(runs)
        }

        def evaluate(points: Mapping[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], tuple[float, np.ndarray]]:
            names = list(points)
            each = [fits[name].spread(points[name]) for name in names]
            weights = np.stack([w for w, _ in each], axis=2).reshape(terms, -1)
            bias = np.stack([b for _, b in each], axis=1)
            loss, out, offs = _pass(own, weights, bias, np.array([f for f, _ in names]))
            out = out.reshape(terms, -1, len(names))
            return {name: fits[name].value(points[name], loss[k], out[:, :, k], offs[:, k]) for k, name in enumerate(names)}

        found = minimise_all(evaluate, {name: fit.steps for name, fit in fits.items() if fit.constant is None})
    finally:
        blocks.unpersist()
    ends = [[fits[f, k].spread(found[f, k]) if (f, k) in found else fits[f, k].known() for k in range(len(runs))] for f in range(folds)]
    weights = np.stack([np.stack([w for w, _ in fold], axis=2) for fold in ends], axis=2)
    return weights, np.stack([np.stack([b for _, b in fold], axis=1) for fold in ends], axis=1)


def fold_predictions(
    counted: DataFrame, counts: tuple[Column, Column], idf: np.ndarray, runs: Mapping[str, Strength], documents: Mapping[int, int]
) -> DataFrame:
    """(dataset: (run, fold), label, prediction) of every row with a ``label`` and a ``fold``, by the fits of the other folds.

    ``counts`` are the indices and values of the rows, ``idf`` the frequencies (term, fold), zero outside a fold's vocabulary.
    """
    rows = counted.select("label", "fold", counts[0].alias("column"), counts[1].alias("value"))
    weights, bias = _models(rows, idf, list(runs.values()), documents)
    terms, classes, folds, many = weights.shape
    sent = rows.sparkSession.sparkContext.broadcast((weights.reshape(terms, -1), bias, idf))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        weights, bias, idf = sent.value
        for batch in batches:
            for part in blocks_of(batch):
                held = Entries.of(*entries(part))
                matrix = held.matrix()
                fold, at = part["fold"].to_numpy().astype(np.int64), np.arange(len(part))
                z = held.times(weights, matrix).reshape(-1, classes, folds, many)[at, :, fold]
                z = z * _shrink(held, idf, matrix)[at, fold][:, None, None] + bias[:, fold].transpose(1, 0, 2)
                best = z.argmax(axis=1).astype(np.int32)
                for k in range(many):
                    yield pa.RecordBatch.from_pydict(
                        {"run": pa.array(np.full(len(part), k, np.int32)), "fold": part["fold"], "label": part["label"], "prediction": pa.array(best[:, k])}
                    )

    types = dict(rows.dtypes)
    scored = rows.mapInArrow(score, f"run int, fold {types['fold']}, label {types['label']}, prediction int")
    name = F.element_at(F.array(*[F.lit(run) for run in runs]), F.col("run") + 1)
    return scored.select(F.struct(name.alias("run"), "fold").alias("dataset"), "label", "prediction")
