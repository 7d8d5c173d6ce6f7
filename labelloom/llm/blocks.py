"""Blocks of documents inside a task: flat byte buffers that numpy reads in whole passes.

A block holds whole documents and about ``limit`` bytes of text, more only if one document is
longer, so the memory of a task follows the block and not the partition. Every document is
followed by one line feed in the flat buffer, so no word spans two documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

BLOCK_BYTES = 4 << 20
#: A missing doc_id counts as larger than every other.
NO_ID = (1 << 63) - 1
#: The blanks that part words: U+0020 and U+0009 to U+000D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: An odd base for hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


@dataclass
class Block:
    """``ids`` (missing ones are ``NO_ID``), ``texts`` in UTF-8 (missing ones are empty),
    ``data``: all bytes, ``start[d]`` to ``start[d + 1] - 1``: the bytes of document ``d``."""

    ids: np.ndarray
    texts: list[bytes]
    data: np.ndarray
    start: np.ndarray
    extra: dict[str, list] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.texts)


def id_and_text(docs: DataFrame, *extra: str) -> DataFrame:
    """The columns a block needs; a missing id becomes ``NO_ID``, a missing text is empty."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *extra,
    )


def with_row(docs: DataFrame) -> tuple[DataFrame, StructType]:
    """doc_id and text beside ``_row``, a struct of all other columns, so that names cannot clash; and the schema."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("_row"))
    return plain, StructType([StructField(f.name, f.dataType) for f in plain.schema])


def without_row(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that ``with_row`` packed, in their order."""
    return df.select(*[changed.get(c, F.col("text") if c == "text" else F.col("_row").getField(c)).alias(c) for c in columns])


def real_id(name: str = "doc_id"):
    """The id as it was given."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def _block(ids: list, texts: list[bytes], extra: dict[str, list], lower: bool) -> Block:
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    start = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)), out=start[1:])
    return Block(np.array(ids, dtype=np.int64), texts, LOWER[data] if lower else data, start, extra)


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES, lower: bool = False) -> Iterator[Block]:
    """Whole documents in blocks of about ``limit`` bytes; columns beside doc_id and text go to ``extra``."""
    ids: list = []
    texts: list[bytes] = []
    extra: dict[str, list] = {}
    size = 0
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("doc_id", "text")]
        more = [batch.column(n).to_pylist() for n in names]
        found = batch.column("text").cast(pa.binary() if not pa.types.is_large_string(batch.schema.field("text").type) else pa.large_binary())
        for k, (one, text) in enumerate(zip(batch.column("doc_id").to_pylist(), found)):
            ids.append(NO_ID if one is None else one)
            texts.append(text.as_py() or b"")
            for n, values in zip(names, more):
                extra.setdefault(n, []).append(values[k])
            size += len(texts[-1]) + 1
            if size >= limit:
                yield _block(ids, texts, extra, lower)
                ids, texts, extra, size = [], [], {}, 0
    if ids:
        yield _block(ids, texts, extra, lower)


@dataclass
class Words:
    """The words of a block in order: where they start and end in ``data``, the document of each,
    its number ``code`` among the distinct words ``types``, and ``first[d]``: the first word of ``d``."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    code: np.ndarray
    types: pa.Array
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def words(block: Block) -> Words:
    inside = ~BLANK[block.data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    offsets = np.zeros(len(start) + 1, dtype=np.int32 if len(block.data) < (1 << 31) else np.int64)
    np.cumsum(end - start, out=offsets[1:])
    kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
    flat = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(offsets), pa.py_buffer(block.data[inside])])
    coded = flat.dictionary_encode()
    first = np.searchsorted(start, block.start)
    doc = np.repeat(np.arange(len(block)), np.diff(first))
    return Words(start, end, doc, coded.indices.to_numpy().astype(np.int64), coded.dictionary, first)


def hash_words(types: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in types.to_pylist()), dtype=np.uint64, count=len(types))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of every ``width`` values in a row, scrambled."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=total[1:])
    return mix((total[width:] - total[:n]) * powers(UNBASE, n))


def covered(starts: np.ndarray, width: np.ndarray | int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a span that begins in ``starts``."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, size), -1)
    return np.cumsum(change[:-1]) > 0


def column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


def ids_out(ids: np.ndarray) -> pa.Array:
    """Ids as given: ``NO_ID`` is missing again."""
    return pc.if_else(pa.array(ids != NO_ID), pa.array(ids), pa.scalar(None, pa.int64()))
