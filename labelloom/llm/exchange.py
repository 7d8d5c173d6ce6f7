"""Counting of window hashes over all documents, with packed shuffles.

A block of documents sends its hashes as a few compressed arrays, one for each range of hashes
(bucket), in place of one row for each window. A bucket's task sorts the hashes of all blocks and
answers with marks: the hashes of a document that count as repeated, packed for each group of
documents. Within a block equal hashes are combined before they are sent, so a window that occurs
everywhere costs one entry a block. The numbers of buckets and groups follow
``spark.sql.shuffle.partitions``, which is set to suit the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.blocks import BLOCK_BYTES, NO_ID, Block, blocks, id_and_text, mix

BUCKETS_PER_PARTITION = 4
#: Marks go by id, and a missing id is a number below this one, made of the text's hash, so that the
#: documents without id do not meet in one group. Documents that share an id may share marks: a mark
#: names a window by its content, and holds for every document of that id.
NO_KEY = -(1 << 62)
KEY = "_k"

Windows = Callable[[Block], tuple[np.ndarray, np.ndarray]]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _k)."""
    made = F.lit(NO_KEY - 1) - F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))
    return id_and_text(docs.withColumn(KEY, F.coalesce(F.col("doc_id").cast("long"), made)), KEY)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte planes apart (those of sorted numbers shrink well), compressed."""
    parts = []
    for a in arrays:
        parts.append(np.array([ord(a.dtype.kind), a.dtype.itemsize, len(a)], dtype=np.int64).tobytes())
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, size, n = np.frombuffer(raw, dtype=np.int64, count=3, offset=at).tolist()
        planes = np.frombuffer(raw, dtype=np.uint8, count=size * n, offset=at + 24).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{size}"))
        at += 24 + size * n
    return out


def _small(a: np.ndarray, limit: int) -> np.ndarray:
    return a.astype(np.uint16 if limit < (1 << 16) else np.uint32)


def _repeats(h: np.ndarray, keys: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (hash, id); which of the ordered entries are repeated; which stand for their hash.

    ``later``: entries with an id above the least of their hash; otherwise all of a hash that has two.
    Entries without id are equal in order but not the same: where they are the least, each key stands for itself.
    """
    ids = _order(keys)
    by = np.lexsort((keys, ids, h)) if later else np.argsort(h, kind="stable")
    h = h[by]
    first = np.r_[True, h[1:] != h[:-1]][: len(h)]
    if later:
        least = ids[by][np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
        marked = ids[by] > least
        first |= ~marked & np.r_[True, np.diff(keys[by]) != 0][: len(h)]
    else:
        size = np.diff(np.r_[np.flatnonzero(first), len(h)])
        marked = np.repeat(size > 1, size)
    return by, marked, first


def _order(keys: np.ndarray) -> np.ndarray:
    """Ids to compare: those that are missing are larger than all others, and equal."""
    return np.where(keys < NO_KEY, NO_ID, keys)


def _pairs(keys: np.ndarray, h: np.ndarray) -> bytes:
    """(key, hash) pairs, a key's number in place of the key."""
    own, place = np.unique(keys, return_inverse=True)
    return pack(h, _small(place, len(own)), own)


def _unpaired(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    h, place, own = unpack(data)
    return own[place], h


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate([k for k, _ in parts]), np.concatenate([h for _, h in parts])


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)


def marks(docs: DataFrame, windows: Windows, later: bool, limit: int = BLOCK_BYTES) -> DataFrame:
    """(_k, marks): for each document with repeated windows their hashes, distinct and in order, as one binary.

    ``docs``: (doc_id, _k, text, ...). ``windows`` gives the document and the hash of every window of a
    block of ``limit`` bytes that takes part. With ``later`` a window is repeated if it occurs under a smaller id, otherwise
    if it occurs twice anywhere.
    """
    groups = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = BUCKETS_PER_PARTITION * groups

    def send(batches: Iterator[pa.RecordBatch]):
        kinds = [pa.int32(), pa.bool_(), pa.binary()]
        for block in blocks(batches, limit):
            doc, h = windows(block)
            if not len(h):
                continue
            keys = np.array(block.extra[KEY], dtype=np.int64)[doc]
            by, marked, first = _repeats(h, keys, later)
            keys, h = keys[by], h[by]
            rows: list[tuple] = []
            if marked.any():  # known here; they only travel to their document
                rows.append((int(h[0] % np.uint64(n)), True, _pairs(keys[marked], h[marked])))
            keys, h = keys[first], h[first]
            cuts = np.searchsorted(h, (np.arange(1, n, dtype=np.uint64) << np.uint64(32)) // np.uint64(n) << np.uint64(32))
            cuts = np.r_[0, cuts, len(h)]
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                a, z = cuts[bucket], cuts[bucket + 1]
                rows.append((bucket, False, _pairs(keys[a:z], h[a:z])))
            yield from _table(rows, ["bucket", "known", "payload"], kinds).to_batches()

    def answer(table: pa.Table) -> pa.Table:
        rows = list(zip(table["known"].to_pylist(), table["payload"].to_pylist()))
        keys, h = _joined([_unpaired(data) for known, data in rows if not known])
        by, marked, _ = _repeats(h, keys, later)
        at = by[marked]
        keys, h = _joined([(keys[at], h[at]), *(_unpaired(data) for known, data in rows if known)])
        group = (mix(keys.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        by = np.lexsort((keys, group))
        keys, h, group = keys[by], h[by], group[by]
        cuts = np.searchsorted(group, np.arange(groups + 1))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        out = [(g, _pairs(keys[cuts[g] : cuts[g + 1]], h[cuts[g] : cuts[g + 1]])) for g in full]
        return _table(out, ["bucket", "payload"], [pa.int32(), pa.binary()])

    def gather(table: pa.Table) -> pa.Table:
        keys, h = _joined([_unpaired(data) for data in table["payload"].to_pylist()])
        by = np.lexsort((h, keys))
        keys, h = keys[by], h[by]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (h[1:] != h[:-1])][: len(h)]
        keys, h = keys[new], h[new]
        cuts = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)]), len(keys)]
        out = [(int(keys[a]), h[a:z].tobytes()) for a, z in zip(cuts[:-1], cuts[1:])]
        return _table(out, [KEY, "marks"], [pa.int64(), pa.binary()])

    sent = docs.mapInArrow(send, "bucket int, known boolean, payload binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "bucket int, payload binary")
    return answers.groupBy("bucket").applyInArrow(gather, f"{KEY} long, marks binary")


def hashes(found: bytes | None) -> np.ndarray:
    """The distinct hashes of a document's marks, in order."""
    return np.frombuffer(found or b"", dtype=np.uint64)


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values
