"""Suffix-array deduplication of byte strings by bucket-pointer refinement (operator 10).

A suffix's bucket is named by its first q bytes, and a bucket is refined by the buckets of its
suffixes q bytes later: names of 8 bytes are joined with the names 8 bytes on to names of 16 bytes,
those again to 32, 64, 128 and 256, and two of these to names of the whole length. Equal names sort
together, and that is all that is needed of the order, so names are 64-bit hashes and no rank has to
be handed out by one task.

Only suffixes whose bucket may hold another are refined over the corpus. Every string of ``width``
bytes holds a fixed number of 64-byte suffixes; the one with the least name is its pivot, and equal
strings have equal pivots. Neighbouring strings mostly share a pivot, and such a run is one row:

1. Runs are bucketed by the name of their pivot. Runs alone in their bucket have no equals and drop out.
2. Buckets are refined by the name of all bytes that a run spans. Runs with equals repeat whole.
3. What is left (the ends of repeats) is refined to the names of single strings, and counted. One run
   of each class of step 2 takes part where its bucket is still open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.blocks import Block, blocks, covered, ids_out, mix
from labelloom.llm.exchange import KEY, among, hashes, keyed, marks
from labelloom.session import cut_lineage, settle

WIDTH = 400
#: Bytes of a pivot.
PIVOT = 64
#: A block needs about 100 times its size, as every byte begins a suffix with names of 8 bytes.
LIMIT = 1 << 21
_A = np.uint64(0x9FB21C651E98DF25)
_LOW = np.uint64(0xFFFFFFFF)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of two names. Not a sum of their multiples: equal differences of ``a`` and ``b`` could cancel."""
    return mix((a ^ (a >> np.uint64(32))) * _A + b)


def _names(data: np.ndarray, width: int, pivot: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the ``pivot`` bytes and of the ``width`` bytes from each place on."""
    name = data.astype(np.uint64)
    for k in (1, 2, 4):  # up to 8 bytes the name is the bytes themselves
        name = name[:-k] | (name[k:] << np.uint64(8 * k))
    name = mix(name)  # so that no change of single bytes is a difference that names have in common
    size, early = 8, name
    while 2 * size <= width:
        name = _join(name[:-size], name[size:])
        size *= 2
        if size == pivot:
            early = name
    if size < width:
        name = _join(name[: size - width], name[width - size :])
    return early, name


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[: len(values)] = values
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Runs:
    """Starts of whole strings (``at``: place, ``doc``, ``name``) and the runs they form: the first start
    of each run (``cut``, one more at the end), its pivot's name and the name of all it spans."""

    at: np.ndarray
    doc: np.ndarray
    name: np.ndarray
    cut: np.ndarray
    pivot: np.ndarray
    whole: np.ndarray

    def of(self) -> np.ndarray:
        """The run of each start."""
        return np.repeat(np.arange(len(self.pivot)), np.diff(self.cut))


def find_runs(block: Block, width: int, pivot: int = PIVOT) -> Runs:
    none = np.zeros(0, dtype=np.int64)
    sizes = np.diff(block.start) - 1
    n = np.maximum(sizes - width + 1, 0)
    if not n.sum():
        return Runs(none, none, none.view(np.uint64), np.zeros(1, dtype=np.int64), none.view(np.uint64), none.view(np.uint64))
    doc = np.repeat(np.arange(len(block)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + block.start[doc]
    early, name = _names(block.data, width, pivot)
    # the leftmost pivot of least name: names and places in one number
    key = (early & ~_LOW) | np.arange(len(early), dtype=np.uint64)
    place = (_least(key, width - pivot + 1)[at] & _LOW).astype(np.int64)
    name = name[at]
    new = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]
    cut = np.r_[np.flatnonzero(new), len(at)]
    first, last = cut[:-1], cut[1:] - 1
    whole = _join(_join(name[first], name[last]), (last - first).astype(np.uint64))
    return Runs(at, doc, name, cut, early[place[first]], whole)


def _runs(own: DataFrame, width: int) -> DataFrame:
    """(pivot, whole, _k): all runs of all documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        for block in blocks(batches, LIMIT):
            r = find_runs(block, width)
            d = r.doc[r.cut[:-1]]
            yield pa.RecordBatch.from_pydict(
                {"pivot": r.pivot.view(np.int64), "whole": r.whole.view(np.int64), KEY: np.array(block.extra[KEY], dtype=np.int64)[d]}
            )

    return own.mapInArrow(run, f"pivot long, whole long, {KEY} long")


def _decide(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((_k, whole) of runs that repeat whole, the same of runs still open)."""
    shared = cut_lineage(runs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("pivot"))
    left = settle(runs.join(shared, "pivot", "left_semi"))
    classes = settle(left.groupBy("pivot", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(KEY).alias(KEY)))
    twice = left.join(classes.filter("n > 1").select("pivot", "whole"), ["pivot", "whole"], "left_semi")
    unsure = classes.filter("n = 1").select("pivot").distinct()
    back = classes.filter("n > 1").join(unsure, "pivot", "left_semi")
    open_ = classes.filter("n = 1").select(KEY, "whole").unionByName(back.select(KEY, "whole"))
    return twice.select(KEY, "whole"), open_


def _listed(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy(KEY).agg(F.collect_set("whole").alias(name))


def _whole(values: list | None) -> np.ndarray:
    return np.unique(np.array(values or (), dtype=np.int64).view(np.uint64))


def _in_runs(r: Runs, lists: list, n: int) -> np.ndarray:
    """Which starts lie in a run that is listed for its document."""
    hit = np.zeros(len(r.pivot), dtype=bool)
    cuts = np.searchsorted(r.doc[r.cut[:-1]], np.arange(n + 1)) if len(r.pivot) else np.zeros(n + 1, dtype=np.int64)
    for d, values in enumerate(lists):
        if values:
            hit[cuts[d] : cuts[d + 1]] = among(r.whole[cuts[d] : cuts[d + 1]], _whole(values))
    return hit[r.of()]


def _judged(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text, twice, marks): all that tells which strings of a document repeat."""
    own = keyed(docs)
    twice, open_ = _decide(settle(_runs(own, width)))
    lists = _listed(twice, "twice").join(_listed(open_, "open"), KEY, "full")
    text = own.join(lists, KEY, "left").select("doc_id", KEY, "text", "twice", "open")

    def windows(block: Block) -> tuple[np.ndarray, np.ndarray]:
        r = find_runs(block, width)
        hit = _in_runs(r, block.extra["open"], len(block))
        return r.doc[hit], r.name[hit]

    found = marks(text.filter("open IS NOT NULL"), windows, later=False, limit=LIMIT)
    return text.join(found, KEY, "left").select("doc_id", "text", "twice", "marks")


def _gone(block: Block, width: int) -> np.ndarray:
    """Which bytes of a block go."""
    out = np.zeros(len(block.data), dtype=bool)
    if any(a or b for a, b in zip(block.extra["twice"], block.extra["marks"])):
        r = find_runs(block, width)
        hit = _in_runs(r, block.extra["twice"], len(block))
        cuts = np.searchsorted(r.doc, np.arange(len(block) + 1))
        for d, parts in enumerate(block.extra["marks"]):
            if parts:
                hit[cuts[d] : cuts[d + 1]] |= among(r.name[cuts[d] : cuts[d + 1]], hashes(parts))
        out = covered(r.at[hit], width, len(block.data))
    return out


def _result(docs: DataFrame, width: int, digest: bool) -> DataFrame:
    name, kind = ("kept_sha256", "string") if digest else ("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]):
        for block in blocks(batches, LIMIT):
            gone = _gone(block, width)
            lost, spans, kept = [], [], []
            for d, text in enumerate(block.texts):
                own = gone[block.start[d] : block.start[d] + len(text)]
                lost.append(int(own.sum()))
                spans.append(int(np.count_nonzero(np.diff(own.view(np.int8), prepend=0) == 1)) if lost[-1] else 0)
                rest = np.frombuffer(text, dtype=np.uint8)[~own].tobytes() if lost[-1] else text
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids_out(block.ids),
                    "n_bytes": pa.array([len(t) for t in block.texts], pa.int64()),
                    "n_removed": pa.array(lost, pa.int64()),
                    "n_spans": pa.array(spans, pa.int64()),
                    name: pa.array(kept, pa.string() if digest else pa.binary()),
                }
            )

    return _judged(docs, width).mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} {kind}")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    A byte goes if a string of ``width`` bytes over it also starts anywhere else, in its own or another
    document, judged on the input. ``width`` is 128 or more. Null and short texts lose nothing; null and
    repeated ids are documents like any other. An empty table gives an empty one. Other columns are ignored.
    """
    return _result(docs, width, digest=False)


def repeat_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """As ``remove_repeats``, with the SHA-256 of the remaining bytes in their place (``kept_sha256``)."""
    return _result(docs, width, digest=True)
