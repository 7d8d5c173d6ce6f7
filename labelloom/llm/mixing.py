"""Mix sources to target weights (operator 7), with DataFrame functions only.

Every document is to be taken ``target / source_size`` times on average. The whole part is taken
as it is. The fraction is settled by pivotal dependent rounding: two documents meet, and a random
one of them passes as many words of expectation to the other as it takes to bring one of the two
to 0 or 1. The words expected of a source stay the same at every meeting, so the words taken miss
the target by less than the one document that is left over, and each document keeps its own
expectation. Meetings run in a reduction tree: leaves are small groups of one source, size class
and hash range, each leaf passes its one open document on, then each size class, so the last level
sees one document for each size class of a source, whatever the size of the source.

Rows of one source, id and size are interchangeable. They are counted first and dealt out to lots
of ``LOT`` rows: as many of a lot as its fractions add up to are taken, and only what is left over
meets others, as one document. So no group of equal rows, rows without id among them, grows a leaf.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.ordinal import global_ordinal
from labelloom.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_COPIES = 2.0
LEAF_ROWS = 32
#: Hash bits that one level of the tree settles.
LEVEL_BITS = 5
#: Equal rows that are settled as one document.
LOT = 1024
#: ``sure`` of ``n`` equal rows are taken, and one more with chance ``p``.
ITEM = "struct<size:bigint,doc_id:bigint,lot:bigint,n:int,sure:int,p:double>"
DONE = "struct<size:bigint,doc_id:bigint,n:int,up:int>"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """(source, source_size) with ``target``: words by weight, none above ``cap`` times its size.

    Weights go to the sources by code point, null last, by their places in a range sort. All open sources
    stand at one level of words a unit of weight; those that are full at it stop, and the level rises by what they leave over
    until no more stop. Each step is one aggregate that gives a row for each weight, so any number of sources will do.
    """
    named = global_ordinal(sources.select("source", "source_size", F.col("source").isNull().alias("_none")), ["_none", "source"], "_place")
    rows = cut_lineage(named.select("source", "source_size", ((F.col("_place") - 1) % len(weights)).cast("int").alias("_slot")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("_slot") + 1)
    full = F.col("source_size") * F.lit(cap)

    def at(level: float | None) -> tuple[Column, float, int]:
        """Who stops at a level; the level that follows from that, and how many are open."""
        stop = F.lit(False) if level is None else full <= F.lit(level) * weight
        figures = (F.sum("source_size").alias("all"), F.sum(F.when(stop, F.col("source_size")).otherwise(0)).alias("held"), F.sum((~stop).cast("long")).alias("open"))
        found = sorted(rows.groupBy("_slot").agg(*figures).collect())
        heavy = sum(weights[r["_slot"]] * r["open"] for r in found)
        left = share * sum(r["all"] for r in found) - cap * sum(r["held"] for r in found)
        return stop, left / heavy if heavy else math.inf, sum(r["open"] for r in found)

    stop, level, open_ = at(None)
    while open_:
        more, higher, left = at(level)
        if left == open_:
            break
        stop, level, open_ = more, max(level, higher), left
    goal = F.when(stop, full).otherwise(F.lit(level) * weight) if open_ else full
    return rows.select("source", "source_size", goal.alias("target"))


def _chance(a: Column, b: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the two documents only."""
    h = F.xxhash64(F.lit(seed), a["doc_id"], a["size"], a["lot"], b["doc_id"], b["size"], b["lot"])
    return F.shiftrightunsigned(h, 11) * F.lit(2.0**-53)


def _item(x: Column, p: Column) -> Column:
    same = [x[c].alias(c) for c in ("size", "doc_id", "lot", "n", "sure")]
    return F.struct(*same, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))


def _done(x: Column, up: int | Column) -> Column:
    up = F.lit(up) if isinstance(up, int) else up
    return F.array(F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["n"].alias("n"), (x["sure"] + up).alias("up")))


def _settle(items: Column, seed: int) -> Column:
    """All documents of a sorted array meet in turn: ``done`` ones, and the one still open."""

    def meet(acc: Column, x: Column) -> Column:
        a = acc["open"]
        room_a, room_b = (1 - a["p"]) * a["size"], (1 - x["p"]) * x["size"]
        has_a, has_b = a["p"] * a["size"], x["p"] * x["size"]
        to_a, to_b = F.least(room_a, has_b), F.least(has_a, room_b)
        a_gains = (_chance(a, x, seed) * (to_a + to_b) < to_b) | (to_a + to_b == 0)

        def end(done: Column, open_: Column) -> Column:
            return F.struct(F.concat(acc["done"], done).alias("done"), open_.alias("open"))

        return (
            F.when(a.isNull(), F.struct(acc["done"].alias("done"), _item(x, x["p"]).alias("open")))
            .when(a_gains & (room_a <= has_b), end(_done(a, 1), _item(x, x["p"] - room_a / x["size"])))
            .when(a_gains, end(_done(x, 0), _item(a, a["p"] + has_b / a["size"])))
            .when(has_a <= room_b, end(_done(a, 0), _item(x, x["p"] + has_a / x["size"])))
            .otherwise(end(_done(x, 1), _item(a, a["p"] - room_b / a["size"])))
        )

    empty = F.struct(F.array().cast(f"array<{DONE}>").alias("done"), F.lit(None).cast(ITEM).alias("open"))
    return F.aggregate(items, empty, meet)


def _largest_first(items: Column) -> Column:
    return F.sort_array(F.collect_list(items), asc=False)


def round_fractions(rows: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """(source, doc_id, size, p) with 0 < p < 1 and size > 0: ``up`` is 1 with chance ``p``, else 0. ``p`` is the same for equal rows."""
    levels = max(0, math.ceil(math.log2(max(n_rows, 1) / LEAF_ROWS) / LEVEL_BITS)) if n_rows > LEAF_ROWS else 0
    equal = rows.groupBy("source", "doc_id", "size").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("n"))
    lots = equal.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT))))
    lots = lots.withColumn("n", F.least(F.lit(LOT), F.col("n") - F.col("lot") * LOT).cast("int"))
    words = F.col("n") * F.col("p")
    item = F.struct("size", "doc_id", "lot", "n", F.floor(words).cast("int").alias("sure"), (words - F.floor(words)).alias("p"))
    placed = lots.select(
        "source",
        F.floor(F.log2("size") * 2).alias("cls"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "lot"), F.lit(1 << (LEVEL_BITS * levels))).alias("leaf"),
        item.cast(ITEM).alias("item"),
    )
    open_ = placed
    decided = []
    for level in range(levels + 1):
        # the last of these sees at most about 2**LEVEL_BITS documents of a size class
        met = open_.groupBy("source", "cls", "leaf").agg(_settle(_largest_first(F.col("item")), seed + level).alias("met"))
        met = cut_lineage(met)
        decided.append(met.select("source", F.explode("met.done").alias("d")))
        open_ = met.select("source", "cls", F.shiftright("leaf", LEVEL_BITS).alias("leaf"), F.col("met.open").alias("item"))
    met = open_.groupBy("source").agg(_settle(_largest_first(F.col("item")), seed + levels + 1).alias("met"))
    left = F.col("met.open")
    lucky = (_chance(left, left, seed + levels + 2) < left["p"]).cast("int")
    last = met.select("source", F.explode(F.concat("met.done", _done(left, lucky))).alias("d"))
    for part in decided:
        last = last.unionByName(part)
    one = F.explode(F.sequence(F.lit(1), F.col("d.n"))).alias("place")
    each = last.select("source", "d.doc_id", "d.size", F.col("d.up").alias("taken"), one)
    return each.select("source", "doc_id", "size", (F.col("place") <= F.col("taken")).cast("int").alias("up"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = TOTAL_SHARE,
    cap: float = MAX_COPIES,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``size`` counts words (a null or blank text has none and is taken 0 times); a null source is a
    source of its own, the last one; null ids and repeated rows are documents like any other. Equal
    ids, sizes and sources are interchangeable. An empty table gives an empty one. Other columns are
    ignored. Only (doc_id, source, size) is shuffled. Reruns agree: chances are hashes of the ids,
    and groups are sorted.
    """
    sized = cut_lineage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"))
    )
    by_source = cut_lineage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    n_rows = sized.count()
    per_row = by_source.select(F.col("source").alias("_s"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_e"))
    rows = sized.join(per_row, F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "doc_id", "size", F.floor("_e").alias("whole"), (F.col("_e") - F.floor("_e")).alias("p")
    )
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    rounded = round_fractions(rows.filter(open_), n_rows, seed)
    plain = rows.filter(~open_).select("source", "doc_id", "size", F.lit(0).alias("up"))
    facts = by_source.select(
        F.col("source").alias("_s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("_whole"),
    )
    every = rounded.unionByName(plain).join(facts, F.col("source").eqNullSafe(F.col("_s")))
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.col("up")).otherwise(0).cast("long")
    return every.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size")
    )
