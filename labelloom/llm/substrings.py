"""Substring deduplication over fixed windows of words (operator 4).

Every window of ``width`` words gets a Rabin-Karp hash over the XXH64 of its words. All hashes of all
documents are counted, the windows that also start in a document with a smaller id are marked, and
marked windows merge into maximal intervals whose words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelloom.llm.blocks import Block, Words, blocks, covered, hash_words, ids_out, window_hashes, words
from labelloom.llm.exchange import KEY, among, hashes, keyed, marks

WIDTH = 50
SEED = 50


def _windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window within one document."""
    h = window_hashes(hash_words(w.types, SEED)[w.code] if len(w) else np.zeros(0, dtype=np.uint64), width)
    at = np.flatnonzero(w.doc[width - 1 :] == w.doc[: len(h)]) if len(h) else np.zeros(0, dtype=np.int64)
    return at, h[at]


def _removed(block: Block, width: int) -> tuple[Words, np.ndarray]:
    """The words of a block with ``marks``, and which of them go."""
    w = words(block)
    gone = np.zeros(len(w), dtype=bool)
    if any(m for m in block.extra["marks"]):
        at, h = _windows(w, width)
        cuts = np.searchsorted(at, w.first)
        hit = np.zeros(len(at), dtype=bool)
        for d, parts in enumerate(block.extra["marks"]):
            if parts:
                hit[cuts[d] : cuts[d + 1]] = among(h[cuts[d] : cuts[d + 1]], hashes(parts))
        gone = covered(at[hit], width, len(w))
    return w, gone


def _marked(docs: DataFrame, width: int) -> DataFrame:
    own = keyed(docs)

    def windows(block: Block) -> tuple[np.ndarray, np.ndarray]:
        w = words(block)
        at, h = _windows(w, width)
        return w.doc[at], h

    return own.join(marks(own, windows, later=True), KEY, "left").select("doc_id", "text", "marks")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the kept words, joined by blanks).

    Windows are judged on the input. A null or short text loses nothing; a null id counts as larger
    than every other, and rows with equal ids never lose words to each other. An empty table gives an
    empty one. Other columns are ignored.
    """
    return _result(docs, width, digest=False)


def repeat_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """As ``remove_repeats``, with the SHA-256 of the kept text in its place (``kept_sha256``)."""
    return _result(docs, width, digest=True)


def _result(docs: DataFrame, width: int, digest: bool) -> DataFrame:
    name = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]):
        for block in blocks(batches):
            w, gone = _removed(block, width)
            total = np.concatenate([[0], np.cumsum(gone)])
            lost = total[w.first[1:]] - total[w.first[:-1]]
            kept = []
            for d, text in enumerate(block.texts):
                own = text.split()
                if lost[d]:
                    own = [x for x, g in zip(own, gone[w.first[d] : w.first[d + 1]].tolist()) if not g]
                rest = b" ".join(own)
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids_out(block.ids), "n_words": np.diff(w.first), "n_removed": lost, name: pa.array(kept, pa.string())}
            )

    return _marked(docs, width).mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")
