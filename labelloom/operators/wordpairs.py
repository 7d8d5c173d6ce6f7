"""Words and pairs of neighbouring words, counted by Arrow batches.

Terms are the words and each pair of neighbours joined with one blank; no word holds a blank. Within a
block of rows words are numbers and a pair is two of them, so that strings are built for distinct pairs
only, not for each that occurs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a block, and rows; a single row may hold more words. Keys of (pair, row) then fit in 63 bits.
BLOCK = 1 << 20


def _blocks(words: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that make a block."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    first, before = 0, 0
    while first < len(ends):
        last = min(int(np.searchsorted(ends, before + BLOCK, side="right")), first + BLOCK)
        last = max(last, first + 1)
        yield first, last
        first, before = last, int(ends[last - 1])


def _coded(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row and the number of each word, and the words by number."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    flat = words.flatten().dictionary_encode()
    return np.repeat(np.arange(len(words)), sizes), flat.indices.to_numpy().astype(np.int64), flat.dictionary


def _tally(key: np.ndarray, row: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, group, occurrences, rows) of the distinct keys of each group; rows are in the order of their ``group``."""
    both = np.sort(key * len(group) + row)
    k, r = np.divmod(both, len(group))
    g = group[r]
    head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])])
    new = np.r_[True, both[1:] != both[:-1]]
    return k[head], g[head], np.diff(np.r_[head, len(both)]), np.add.reduceat(new.astype(np.int64), head)


def _tallies(words: pa.Array, group: np.ndarray, pairs: bool) -> Iterator[dict[str, pa.Array]]:
    row, code, known = _coded(words)
    if not len(code):
        return
    order = np.argsort(group, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    row, group = place[row], group[order]
    k, g, tf, df = _tally(code, row, group)
    yield {"term": known.take(pa.array(k)), "by": pa.array(g), "tf": pa.array(tf), "df": pa.array(df)}
    inside = np.flatnonzero(row[1:] == row[:-1])
    if pairs and len(inside):
        k, g, tf, df = _tally(code[inside] * len(known) + code[inside + 1], row[inside], group)
        left, right = (known.take(pa.array(x)) for x in np.divmod(k, len(known)))
        yield {"term": pc.binary_join_element_wise(left, right, " "), "by": pa.array(g), "tf": pa.array(tf), "df": pa.array(df)}


def _counted(df: DataFrame, words: str, pairs: bool, by: Column) -> DataFrame:
    """(term, by, tf, df): partial counts, a row for each block, term and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, group = batch.column("words"), batch.column("by").to_numpy()
            for first, last in _blocks(lists):
                for part in _tallies(lists.slice(first, last - first), group[first:last], pairs):
                    yield pa.RecordBatch.from_pydict({**part, "term": part["term"].cast(pa.string()), "by": part["by"].cast(pa.int32())})

    return df.select(F.col(words).alias("words"), by.cast("int").alias("by")).mapInArrow(run, "term string, by int, tf long, df long")


def word_statistics(df: DataFrame, words: str, pairs: bool) -> DataFrame:
    """(term, tf, df): corpus and document frequency of the words and, with ``pairs``, of the neighbours.

    As ``vocabulary.term_statistics`` of the listed terms. A block of rows is counted in the task and its
    counts combine on the map side, so neither occurrences nor their strings become rows. A row is a
    document; words are not null.
    """
    parts = _counted(df, words, pairs, F.lit(0))
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def fold_word_statistics(df: DataFrame, words: str, pairs: bool, folds: int, fold: str = "fold") -> DataFrame:
    """(term, tf, df, tf_0, df_0, tf_1, ...) as ``vocabulary.fold_statistics`` of the listed terms."""
    parts = _counted(df, words, pairs, F.col(fold))
    own = lambda c, f: F.coalesce(F.sum(F.when(F.col("by") == f, F.col(c))), F.lit(0).cast("long"))
    each = [own(c, f).alias(f"{c}_{f}") for f in range(folds) for c in ("tf", "df")]
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), *each)


class _Vocabulary:
    """Places of words and of pairs in a list of terms."""

    def __init__(self, terms: Sequence[str]):
        parts = [t.split(" ") for t in terms]
        self.words = pa.array(dict.fromkeys(w for p in parts for w in p), pa.string())
        number = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.single = np.full(len(number), -1, dtype=np.int64)
        pairs = {}
        for place, p in enumerate(parts):
            if len(p) == 1:
                self.single[number[p[0]]] = place
            elif len(p) == 2:
                pairs[number[p[0]] * len(number) + number[p[1]]] = place
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.places = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.size = len(terms)

    def counts(self, words: pa.Array) -> pa.Array:
        """Sparse vectors of the counts, as the fields of ``VectorUDT``."""
        row, code, known = _coded(words)
        number = pc.fill_null(pc.index_in(known, self.words), -1).to_numpy().astype(np.int64)[code]
        single = self.single[number] if self.size else number
        own = (number >= 0) & (single >= 0)
        key = row[own] * self.size + single[own]
        if len(self.keys):
            at = np.flatnonzero((row[1:] == row[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0))
            pair = number[at] * len(self.words) + number[at + 1]
            found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = self.keys[found] == pair
            key = np.r_[key, row[at[hit]] * self.size + self.places[found[hit]]]
        key, count = np.unique(key, return_counts=True)
        n = len(words)
        ends = np.r_[0, np.searchsorted(key, (np.arange(n) + 1) * self.size)].astype(np.int32)
        return pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(n, dtype=np.int8)),
                pa.array(np.full(n, self.size, dtype=np.int32)),
                pa.ListArray.from_arrays(ends, (key % max(self.size, 1)).astype(np.int32)),
                pa.ListArray.from_arrays(ends, count.astype(np.float64)),
            ],
            names=["type", "size", "indices", "values"],
        )


def counts_of(words: str, terms: Sequence[str]) -> Column:
    """Sparse vectors: how often each of ``terms`` occurs among the words and the pairs of neighbours."""

    @F.arrow_udf(VectorUDT())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _Vocabulary(terms)
        for batch in batches:
            parts = [vocabulary.counts(batch.slice(first, last - first)) for first, last in _blocks(batch)]
            yield pa.concat_arrays(parts) if parts else vocabulary.counts(batch)

    return count(F.col(words))
