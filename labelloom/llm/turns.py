"""Conversation prefix trie (operator 13) by truncation peeling.

A conversation is a key: the records of its turns in order, each ``RECORD`` bytes, a digest of role and
text and the size of the text. Equal conversations are counted first. Peeling starts at the greatest
depth: conversations that end there and the nodes that came up from below are merged by key, counted,
and lose their last record; that is the next depth. Sums combine on the map side, so a node with a
third of all conversations below it is no hot task.

Most conversations share only their beginning with others. Depths 1, 2, 4, ... are tried on the way
down: where a conversation has no partner, the rest of it is a chain of nodes of its own, which is
written out at once, so the rounds of the peeling follow the depth that is shared, not the longest
conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.session import cut_lineage, settle

#: Bytes of a record: an MD5 digest and the size of the text.
RECORD = 24
DIGEST = 16
#: Turns that one conversation may take from another, at most.
MOST_SHARED = 8
SIBLINGS = 5
#: Numbers in a piece of an id list.
PIECE = 2_000
NOTHING = hashlib.sha256(b"").hexdigest()


def record(role: Column, text: Column) -> Column:
    """A turn as hexadecimal digits; missing role and text count as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.md5(whole.cast("binary")), F.lpad(F.hex(F.octet_length(text)), 2 * (RECORD - DIGEST), "0"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, key) of the conversations as they are.

    Turns stand in order of their number, a missing one first, equal ones by digest. Rows without
    conv_id belong to no conversation. The records of one conversation have to fit in a task
    (24 bytes a turn), its texts do not.
    """
    known = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("n"), F.col("turn").alias("t"), record(F.col("role"), F.col("text")).alias("r")).alias("x"),
    )
    listed = known.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("x", lambda x: x["r"]), "")).alias("key"))


def first(key: Column | str, turns: Column | int) -> Column:
    n = F.lit(turns) if isinstance(turns, int) else turns
    return F.substring(key, F.lit(1), (n * RECORD).cast("int"))


def depth_of(key: Column | str) -> Column:
    return (F.octet_length(key) / RECORD).cast("long")


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation begins with the first h turns of the first of its ``SIBLINGS`` neighbours by
    number and goes on with its own turns after h; h: CRC-32 of its number, modulo 9."""
    heads = convs.select(F.col("conv_id").alias("_base"), first("key", MOST_SHARED).alias("_head"))
    c = F.col("conv_id")
    shared = (F.crc32(c.cast("string").cast("binary")) % (MOST_SHARED + 1)).alias("_h")
    own = convs.select("conv_id", "key", (c - c % SIBLINGS).alias("_base"), shared)
    tail = F.substring("key", (F.col("_h") * RECORD + 1).cast("int"), F.octet_length("key"))
    begin = F.coalesce(first("_head", F.col("_h")), F.lit(b""))
    return own.join(heads, "_base", "left").select("conv_id", F.concat(begin, tail).alias("key"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kid, conv_id) as pieces of id lists."""
    for batch in batches:
        kid, conv = batch.column("kid"), batch.column("conv_id").to_numpy()
        code = kid.dictionary_encode().indices.to_numpy()
        edge = np.flatnonzero(np.diff(code, prepend=-1) != 0)
        cut = np.unique(np.concatenate([edge, np.arange(0, len(code), PIECE)])) if len(code) else edge
        ends = np.append(cut[1:], len(code))
        texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cut, ends)]
        yield pa.record_batch([kid.take(pa.array(cut)), pa.array(conv[cut]), pa.array(texts, pa.string())], ["kid", "start", "ids"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (kid, start) as one digest for each kid, with constant memory."""
    open_, state = None, None
    for batch in batches:
        kids, digests = [], []
        for kid, ids in zip(batch.column("kid").to_pylist(), batch.column("ids").to_pylist()):
            if kid != open_:
                if state is not None:
                    kids.append(open_)
                    digests.append(state.hexdigest())
                open_, state = kid, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.record_batch([pa.array(kids, pa.binary()), pa.array(digests, pa.string())], ["kid", "ends"])
    if state is not None:
        yield pa.record_batch([pa.array([open_], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["kid", "ends"])


def _kid(key: Column | str) -> Column:
    return F.unhex(F.md5(key))


def end_digests(full: DataFrame) -> DataFrame:
    """(kid, ends): for each distinct key the digest of the numbers of the conversations that it is.

    The numbers are sorted by all tasks, joined into pieces there, and only the pieces of one key
    meet in one task, which reads them in order and holds one at a time.
    """
    rows = full.select(_kid("key").alias("kid"), "conv_id")
    ranged = rows.repartitionByRange("kid", "conv_id").sortWithinPartitions("kid", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "kid binary, start long, ids string")
    sorted_ = pieces.repartition("kid").sortWithinPartitions("kid", "start")
    return sorted_.mapInArrow(_streamed, "kid binary, ends string")


def _text_bytes(key: Column | str, turn: Column) -> Column:
    at = ((turn - 1) * RECORD + DIGEST + 1).cast("int")
    return F.conv(F.hex(F.substring(key, at, F.lit(RECORD - DIGEST))), 16, 10).cast("long")


NODE = ("key", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def _part_chains(ended: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, int]:
    """Cut off what no other conversation shares.

    Returns the ends and chain heads to peel (``NODE`` columns), the chain rows
    (conv_id, depth, above, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends),
    and the depth to start from.
    """
    rest, chains, stubs, t = ended, [], [], 1
    while t <= depth:
        # the short ones stay out of the join: without a prefix they would all meet in one task
        longer = rest.filter(F.col("depth") >= t).withColumn("_p", first("key", t))
        partners = longer.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        marked = cut_lineage(longer.join(partners, "_p").drop("_p"))
        chains.append(marked.filter("_n = 1").withColumn("_from", F.lit(t).cast("long")).drop("_n"))
        rest = rest.filter(F.col("depth") < t).unionByName(marked.filter("_n > 1").drop("_n"))
        depth = rest.agg(F.max("depth")).first()[0] or 0
        t *= 2
    if not chains:
        return rest.select(*_ends()), None, depth
    alone = reduce(DataFrame.unionByName, chains)

    each = alone.withColumn("_d", F.explode(F.sequence("_from", "depth")))
    more = F.col("n_convs") - 1
    # only copies of one conversation save anything in a chain
    below = Window.partitionBy("conv_id").orderBy(F.desc("_d"))
    copies = each.filter("n_convs > 1").withColumn("_saved", F.sum(more * _text_bytes("key", F.col("_d"))).over(below))
    rows = each.filter("n_convs = 1").withColumn("_saved", F.lit(0).cast("long")).unionByName(copies)
    last = F.col("_d") == F.col("depth")
    out = rows.select(
        "conv_id",
        F.col("_d").alias("depth"),
        F.when(F.col("_d") == F.col("_from"), first("key", F.col("_d") - 1)).alias("above"),
        F.when(F.col("_d") > F.col("_from"), F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.col("_saved").alias("saved_tokens"),
        F.when(last, F.col("ends")).alias("ends"),
    )
    out = cut_lineage(out)
    stubs = out.filter("above is not null").select(
        F.col("above").alias("key"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens"
    )
    parents = out.filter("above is not null").agg(F.max("depth")).first()[0] or 0
    return rest.select(*_ends()).unionByName(stubs), out, max(depth, parents - 1)


def _ends() -> list[Column]:
    zero = F.lit(0).cast("long")
    return [F.col("key"), F.col("conv_id"), F.col("n_convs"), *[zero.alias(c) for c in NODE[3:]]]


def _peel(start: DataFrame, depth: int) -> DataFrame:
    """All nodes (``NODE``) from the deepest up to the root."""
    # one row a key: the heads of all chains below a node would be one group of equal keys
    start = start.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in NODE[2:]])
    # sorted by depth, so that each round reads only the row groups of its own
    start = start.withColumn("_d", depth_of("key"))
    start = settle(start.repartitionByRange("_d", "key").sortWithinPartitions("_d"), "ends")
    done, up = [], None
    for d in range(depth, -1, -1):
        here = start.filter(F.col("_d") == d).drop("_d")
        here = here if up is None else here.unionByName(up)
        sums = [F.sum(c).alias(c) for c in NODE[2:]]
        merged = here.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums)
        own = (F.col("n_convs") - 1) * _text_bytes("key", F.lit(d)) if d else F.lit(0)
        nodes = cut_lineage(
            merged.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1))).withColumn("saved_tokens", F.col("saved_tokens") + own)
        )
        done.append(nodes)
        if d:
            up = nodes.select(first("key", d - 1).alias("key"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
    return reduce(DataFrame.unionByName, done)


def prefix_nodes(convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of (conv_id, key), conv_id being unique: conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Digests stand for turns (MD5 of role and text, 128 bits). A table without conversations has no node.
    """
    full = settle(convs.select("conv_id", "key"), "convs")
    ends = end_digests(full).withColumnRenamed("kid", "_kid")
    counted = full.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    joined = counted.join(ends, _kid("key") == F.col("_kid"), "left").drop("_kid")
    ended = settle(joined.withColumn("depth", depth_of("key")), "distinct")
    depth = ended.agg(F.max("depth")).first()[0]
    if depth is None:
        depth = 0
    start, chains, depth = _part_chains(ended, depth)
    nodes = _peel(start, depth)

    with_depth = nodes.withColumn("depth", depth_of("key"))
    above = F.when(F.col("depth") > 0, first("key", F.col("depth") - 1))
    own = with_depth.withColumn("above", above).join(ended.select("key", "ends"), "key", "left")
    columns = ("conv_id", "depth", "above", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    open_, settled_ = own.select(*columns), None
    if chains is not None:
        heads = chains.filter("above is not null").select(*columns)
        open_, settled_ = open_.unionByName(heads), chains.filter("above is null").drop("above")
    parents = nodes.select(F.col("key").alias("_key"), F.col("conv_id").alias("parent_conv_id"))
    out = open_.join(parents, F.col("above") == F.col("_key"), "left").drop("above", "_key")
    if settled_ is not None:
        out = out.unionByName(settled_)
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )


def trie(turns: DataFrame) -> DataFrame:
    """``prefix_nodes`` of the rebuilt conversations of a table (conv_id, turn, role, text).

    Other columns are ignored; repeated rows are turns of their own; see ``sequences`` for the rest.
    """
    return prefix_nodes(rebuilt(settle(sequences(turns), "sequences")))
