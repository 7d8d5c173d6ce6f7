"""Exact top-k search by inner product (operator 11): aggregation without random access.

Vectors are packed into blocks. A block has one sorted list for each dimension, read from its top for
queries with a positive weight there and from its bottom for the others. Lists are read to ever greater
depths; a masked matrix product adds what has been read for a batch of queries at once. What a list has
not shown yet lies between its frontier and its far end, which bounds every score from above and below.
The k-th best lower bound is the limit to beat: reading stops when no vector outside the lists read so
far can reach it and few others still can; those are then scored in full. The limit is carried from
block to block, so later blocks are read less deep.

Queries and blocks meet in a grid: a cell gets a share of the blocks and a share of the queries, both
bounded in bytes, and returns the k best of each query; a partial and a final rank merge the cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.session import settle

SCALE = 1024
K = 10
EVERY = 100
BLOCK_ROWS = 1_024
QUERY_ROWS = 256
#: Bytes of packed vectors and of packed queries that a cell of the grid holds.
CELL_BYTES = 48 << 20
#: Scaled components of this size or more count as not finite: sums of products stay within a long.
LIMIT = 1 << 27
#: Depths at which reading may stop, as parts of a list.
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4)
#: Part of a block that may be left to score in full.
OPEN_SHARE = 1 / 8

PACKED = "block long, dims int, ids binary, at binary, own binary, data binary"
FOUND = "qblock long, qat int, query_id long, vec_id long, score long"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, flat values and where a value is missing, of a batch of vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    sizes = np.nan_to_num(np.asarray(column.value_lengths().to_pandas(), dtype=np.float64)).astype(np.int64)
    flat = column.flatten()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return ends, flat.to_numpy(zero_copy_only=False), sizes


def _usable(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and scaled vectors of the rows that take part."""
    known = np.asarray(batch.column("vec_id").is_valid()) & np.asarray(batch.column("embedding").is_valid())
    batch = batch.filter(pa.array(known))
    if not batch.num_rows:
        return np.zeros(0, dtype=np.int64), []
    ends, flat, sizes = _lists(batch.column("embedding"))
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(flat * scale)
        bad = ~(np.abs(scaled) < LIMIT)
    fails = np.concatenate([[0], np.cumsum(bad)])
    good = np.flatnonzero(fails[ends[1:]] == fails[ends[:-1]])
    scaled = np.where(bad, 0, scaled).astype(np.int32)
    ids = batch.column("vec_id").to_numpy()
    return ids[good], [scaled[ends[i] : ends[i + 1]] for i in good]


def _row(block: int, ids, at, own, vectors: list[np.ndarray]) -> pa.RecordBatch:
    """One packed block; shorter vectors end with zeros."""
    dims = max(map(len, vectors), default=0)
    data = np.zeros((len(vectors), dims), dtype=np.int32)
    for row, v in zip(data, vectors):
        row[: len(v)] = v
    if dims and np.abs(data).max() < 1 << 15:
        data = data.astype(np.int16)
    values = [block, dims, np.asarray(ids, np.int64).tobytes(), np.asarray(at, np.int32).tobytes(), np.asarray(own, np.int64).tobytes(), data.tobytes()]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], ["block", "dims", "ids", "at", "own", "data"])


def _matrix(row: dict) -> tuple[np.ndarray, ...]:
    """Ids, places, blocks and values of a packed block."""
    ids = np.frombuffer(row["ids"], np.int64)
    at, own = np.frombuffer(row["at"], np.int32), np.frombuffer(row["own"], np.int64)
    cells = len(ids) * row["dims"]
    kind = np.int16 if cells and len(row["data"]) == 2 * cells else np.int32
    return ids, at, own, np.frombuffer(row["data"], kind).reshape(len(ids), row["dims"])


def pack(vectors: DataFrame, scale: int = SCALE, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of scaled vectors, written to the shared folder so that places in them are fixed."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held = np.zeros(0, dtype=np.int64), []
        for batch in batches:
            more, own = _usable(batch, scale)
            ids, held = np.concatenate([ids, more]), held + own
            while len(held) >= rows:
                yield _row(number, ids[:rows], np.arange(rows), np.full(rows, number), held[:rows])
                ids, held, number = ids[rows:], held[rows:], number + 1
        if held:
            yield _row(number, ids, np.arange(len(held)), np.full(len(held), number), held)

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return settle(plain.mapInArrow(packed, PACKED), "blocks")


def _queries(blocks: DataFrame, every: int) -> DataFrame:
    """The rows of the blocks whose id is divisible by ``every``, packed again with their places."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, own, data = _matrix(row)
                held += [(ids[i], at[i], own[i], data[i].astype(np.int32)) for i in np.flatnonzero(ids % every == 0)]
            while len(held) >= QUERY_ROWS:
                yield _row(number, *map(list, zip(*held[:QUERY_ROWS])))
                held, number = held[QUERY_ROWS:], number + 1
        if held:
            yield _row(number, *map(list, zip(*held)))

    return settle(blocks.mapInArrow(chosen, PACKED), "queries")


def _widened(data: np.ndarray, dims: int, kind: type) -> np.ndarray:
    out = np.zeros((len(data), dims), dtype=kind)
    out[:, : data.shape[1]] = data
    return out


def read_lists(values: np.ndarray, queries: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs of a block that may be among the ``k`` best of the query.

    ``own[q]`` is the row of query ``q`` in this block or -1; ``limit[q]`` a score that the ``k``-th best
    of it has at least. No pair that reaches the final limit is left out.
    """
    m, n = len(values), len(queries)
    ordered = np.sort(values, axis=0)
    place = np.empty(values.shape, dtype=np.int32)
    np.put_along_axis(place, np.argsort(values, axis=0, kind="stable"), np.arange(m, dtype=np.int32)[:, None], axis=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    far = up @ ordered[0] + down @ ordered[-1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    still = np.arange(n)
    limit = limit.astype(values.dtype)
    depths = sorted({d for d in (int(m * part) for part in DEPTHS) if d >= 2 * k} | {m})
    for depth in depths:
        # what the lists have shown: places from the top and from the bottom
        top, low = ordered[m - depth], ordered[depth - 1]
        unseen = up[still] @ top + down[still] @ low
        # while outsiders can still qualify there is nothing to decide, once a limit is known
        go = np.flatnonzero((unseen < limit[still]) | (depth == m) | np.isneginf(limit[still]))
        if not len(go):
            continue
        q = still[go]
        from_top, from_low = place >= m - depth, place < depth
        lower = far[q, None] + up[q] @ np.where(from_top, values - ordered[0], 0).T + down[q] @ np.where(from_low, values - ordered[-1], 0).T
        mine = np.flatnonzero(own[q] >= 0)
        lower[mine, own[q][mine]] = -np.inf
        if m > k:
            limit[q] = np.maximum(limit[q], np.partition(lower, m - k, axis=1)[:, m - k])
        if depth == m:
            upper = lower
        else:
            upper = unseen[go, None] + up[q] @ np.where(from_top, values - top, 0).T + down[q] @ np.where(from_low, values - low, 0).T
            upper[mine, own[q][mine]] = -np.inf
        open_ = (upper >= limit[q, None]) & (upper > -np.inf)
        done = (open_.sum(axis=1) <= max(k, m * OPEN_SHARE)) & (unseen[go] < limit[q]) | (depth == m)
        rows, cols = np.nonzero(open_[done])
        found.append((q[done][rows], cols))
        still = np.setdiff1d(still, q[done], assume_unique=True)
        if not len(still):
            break
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each query, best first."""
    order = np.lexsort((ids, -score, query))
    sorted_ = query[order]
    begin = np.searchsorted(sorted_, sorted_)
    return order[np.arange(len(order)) - begin < k]


def search(blocks: list[dict], queries: list[dict], k: int = K) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of every query among the vectors of the blocks of a cell."""
    for held in queries:
        q_ids, q_at, q_own, q_data = _matrix(held)
        n = len(q_ids)
        query, ids, score = (np.zeros(0, dtype=np.int64) for _ in range(3))
        limit = np.full(n, -np.inf)
        for block in blocks:
            v_ids, _, _, v_data = _matrix(block)
            dims = max(q_data.shape[1], v_data.shape[1])
            size = max(int(np.abs(q_data).max(initial=0)), 1) * max(int(np.abs(v_data).max(initial=0)), 1) * max(dims, 1)
            small = size < 1 << 52
            q_all, v_all = _widened(q_data, dims, np.int64), _widened(v_data, dims, np.int64)
            own = np.where(q_own == block["block"], q_at, -1)
            if small and dims:
                rows, cols = read_lists(v_all.astype(float), q_all.astype(float), own, limit, k)
            else:
                # bounds would not be exact in floating point (or there is nothing to order): every pair is scored
                rows, cols = np.nonzero(np.arange(len(v_ids)) != own[:, None])
            for start in range(0, len(rows), 1 << 18):
                r, c = rows[start : start + (1 << 18)], cols[start : start + (1 << 18)]
                query = np.concatenate([query, r])
                ids = np.concatenate([ids, v_ids[c]])
                score = np.concatenate([score, (q_all[r] * v_all[c]).sum(axis=1)])
                keep = _best(query, ids, score, k)
                query, ids, score = query[keep], ids[keep], score[keep]
            counts = np.bincount(query, minlength=n)
            last = np.cumsum(counts) - 1
            limit = np.where(counts == k, score[last] if len(score) else 0, -np.inf)
        columns = [q_own[query], q_at[query], q_ids[query], ids, score]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["qblock", "qat", "query_id", "vec_id", "score"])


def _cells(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each cell of the grid."""

    def bytes_of(df: DataFrame) -> int:
        return df.agg(F.sum(F.octet_length("data") + F.octet_length("ids"))).first()[0] or 0

    cores = blocks.sparkSession.sparkContext.defaultParallelism
    tall = max(2 * cores, math.ceil(bytes_of(blocks) / CELL_BYTES))
    wide = max(1, math.ceil(bytes_of(queries) / CELL_BYTES))

    def share(parts: int):
        return F.pmod(F.xxhash64("block"), F.lit(parts))

    left = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("_w"))
    left = left.select((share(tall) * wide + F.col("_w")).alias("cell"), *blocks.columns)
    right = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(tall - 1))).alias("_t"))
    right = right.select((F.col("_t") * wide + share(wide)).cast("long").alias("cell"), *queries.columns)

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        found = list(search(a.to_pylist(), b.to_pylist(), k)) if a.num_rows and b.num_rows else []
        empty = pa.schema([("qblock", pa.int64()), ("qat", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        return pa.Table.from_batches(found, schema=empty)

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(cell, FOUND)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` (vec_id, embedding) with the highest
    inner product, for each row whose vec_id is divisible by ``every``, among all rows but itself.

    Components count as ``floor(scale * x)``. Equal scores go to the smaller vec_id. Rows without vec_id
    and vectors that are null or hold a null, a component that is not finite or a scaled one of 2**27
    or more take no part; shorter vectors end with zeros, an empty one scores 0. Repeated rows are rows
    of their own, as queries too. Fewer than ``k`` others: all of them. Other columns are ignored; an
    empty table gives an empty one. Scores have to fit in a long.
    """
    blocks = pack(vectors, scale)
    found = _cells(blocks, _queries(blocks, every), k)
    order = Window.partitionBy("qblock", "qat").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
