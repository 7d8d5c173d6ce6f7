"""Products of a block of sparse rows with narrow matrices, in numpy.

Columns that many rows of the block hold are a matrix, made anew for each product; the entries of the
others are summed one by one, rows of similar length together. What is kept are the entries, in the
smallest types that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Rows of a block and its entries, at most; a single row may hold more.
BLOCK_ROWS, BLOCK_ENTRIES = 2048, 1 << 19
#: A column goes into the matrix if more than one row in so many holds it; numbers of a source gathered at a time.
THICK, GATHERED = 11, 1 << 17

#: (targets, indices, values): rows of the same length, padded with zeros.
Plan = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _small(x: np.ndarray) -> np.ndarray:
    """The same values in the smallest unsigned type, if they are whole."""
    if not len(x) or x.dtype.kind == "f" and ((x < 0) | (x != np.floor(x)) | (x > 1 << 31)).any():
        return x
    return x.astype(np.min_scalar_type(int(x.max())))


def _plan(target: np.ndarray, ends: np.ndarray, index: np.ndarray, value: np.ndarray) -> Plan:
    """For each target the indices and values between its ends, targets of similar length together."""
    count = np.diff(ends)
    order = np.argsort(count, kind="stable")
    ranked, out = count[order], []
    at = int(np.searchsorted(ranked, 1))
    while at < len(order):
        after = int(np.searchsorted(ranked, ranked[at] * 13 // 10, side="right"))
        own, size = order[at:after], int(ranked[after - 1])
        held = np.arange(size) < count[own, None]
        place = np.where(held, ends[own, None] + np.arange(size), 0)
        out.append((target[own], index[place], np.where(held, value[place], value.dtype.type(0))))
        at = after
    return out


def _add_sums(out: np.ndarray, plan: Plan, source: np.ndarray, power: int) -> None:
    """Add to each target row of ``out`` the rows of ``source`` that its indices name, times its values."""
    for target, index, value in plan:
        many, size = index.shape
        step = max(1, GATHERED // (size * source.shape[1]))
        for a in range(0, many, step):
            rows = source.take(index[a : a + step].ravel(), axis=0).reshape(-1, size, source.shape[1])
            times = value[a : a + step, None, :].astype(np.float64) ** power
            out[target[a : a + step]] += np.matmul(times, rows)[:, 0]


@dataclass
class Entries:
    """Rows as entries over the columns that they hold: those of thick columns as places in a matrix, the
    others by row and by column."""

    rows: int
    columns: np.ndarray
    thick: np.ndarray
    row: np.ndarray
    place: np.ndarray
    value: np.ndarray
    by_row: Plan
    by_column: Plan

    @staticmethod
    def of(sizes: np.ndarray, column: np.ndarray, value: np.ndarray) -> Entries:
        """From the columns and values of the rows in their order, a column once a row."""
        rows = len(sizes)
        row, value = np.repeat(np.arange(rows), sizes), _small(value)
        columns, own, count = np.unique(column, return_inverse=True, return_counts=True)
        full = count * THICK > rows
        inside = full[own]
        place = (np.cumsum(full) - 1)[own[inside]]
        thin_row, thin_column, thin_value = row[~inside], column[~inside], value[~inside]
        ends = np.r_[0, np.cumsum(np.bincount(thin_row, minlength=rows))]
        by_row = _plan(np.arange(rows), ends, _small(thin_column), thin_value)
        order = np.argsort(thin_column, kind="stable")
        ends = np.r_[0, np.cumsum(count[~full])]
        by_column = _plan(columns[~full], ends, _small(thin_row[order]), thin_value[order])
        return Entries(rows, columns, columns[full], _small(row[inside]), _small(place), value[inside], by_row, by_column)

    def matrix(self) -> np.ndarray:
        """The thick columns."""
        out = np.zeros((self.rows, len(self.thick)))
        out[self.row, self.place] = self.value
        return out

    def times(self, source: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """The rows times ``source``, which has a row for each column that there may be."""
        out = matrix @ source[self.thick]
        _add_sums(out, self.by_row, source, 1)
        return out

    def squares(self, source: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """The rows with their values squared, times ``source``."""
        out = matrix**2 @ source[self.thick]
        _add_sums(out, self.by_row, source, 2)
        return out

    def add_turned(self, out: np.ndarray, rows: np.ndarray, matrix: np.ndarray, power: int = 1) -> None:
        """Add the turned rows, their values to a ``power``, times ``rows`` to ``out``."""
        out[self.thick] += matrix.T**power @ rows
        _add_sums(out, self.by_column, rows, power)


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries of each row, column, value) of the list columns ``column`` and ``value``."""
    column, value = batch["column"], batch["value"]
    return np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy()


def blocks_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch as blocks."""
    ends, first = np.cumsum(entries(batch)[0]), 0
    while first < len(batch):
        before = int(ends[first - 1]) if first else 0
        last = min(int(np.searchsorted(ends, before + BLOCK_ENTRIES, side="right")), first + BLOCK_ROWS)
        last = max(last, first + 1)
        yield batch.slice(first, last - first)
        first = last
