"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 3).

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the
radius share a variant, and all that share one are within the radius of each other, so each links
to the least of its variant; at most one ball of fingerprints meets in a variant. Copies of a text
share a fingerprint and count once. Components come from the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.blocks import NO_ID, Block, blocks, id_and_text, real_id, words
from labelloom.llm.components import components
from labelloom.session import cut_lineage

SHINGLE = 3
RADIUS = 2
SEED = 42


def _fingerprints(block: Block, shingle: int) -> np.ndarray:
    w = words(block)
    out = np.zeros(len(block), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for d in range(len(block)):
        a, z = w.first[d], w.first[d + 1]
        if a == z:
            continue
        data = b" ".join(block.data[w.start[a] : w.end[z - 1]].tobytes().split())
        sizes = (w.end[a:z] - w.start[a:z]) + 1
        starts = np.cumsum(sizes) - sizes
        k = min(shingle, z - a)
        firsts, lasts = starts[: len(starts) - k + 1].tolist(), (starts + sizes - 1)[k - 1 :].tolist()
        h = np.fromiter((digest(data[i:j], SEED) for i, j in zip(firsts, lasts)), dtype=np.uint64, count=len(firsts))
        ones = np.zeros(64, dtype=np.int64)
        for part in range(0, len(h), 8192):
            bits = np.unpackbits(h[part : part + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[d] = weights[2 * ones > len(h)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *extra: str) -> DataFrame:
    """(doc_id, fp, extra columns): ``fp`` is the fingerprint as a signed long, ``doc_id`` has ``NO_ID`` for null."""

    def run(batches: Iterator[pa.RecordBatch]):
        for block in blocks(batches, lower=True):
            more = {n: pa.array(v, pa.int64()) for n, v in block.extra.items()}
            yield pa.RecordBatch.from_pydict({"doc_id": block.ids, "fp": _fingerprints(block, shingle).view(np.int64), **more})

    schema = "doc_id long, fp long" + "".join(f", {x} long" for x in extra)
    return id_and_text(docs, *extra).mapInArrow(run, schema)


def ball(radius: int) -> list[int]:
    """All masks of at most ``radius`` of 64 bits, as signed longs."""
    found = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links that join all distinct ``fp`` within ``radius`` bits, an even number."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: half of it is hashed on either side")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    near = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    first = F.min("fp").over(Window.partitionBy("variant"))
    pairs = near.select(first.alias("a"), F.col("fp").alias("b")).filter("a <> b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, *extra: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, extra columns, component (the least doc_id reachable).

    Texts without words have fingerprint 0 and link like any other. A null id counts as larger than
    every other (``NO_ID``); repeated rows are linked as equal. An empty table gives an empty one.
    """
    own = cut_lineage(fingerprints(docs, shingle, *extra))
    by_fp = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    by_fp = cut_lineage(by_fp)
    joined = components(links(by_fp.select("fp"), radius))
    rooted = by_fp.join(joined, by_fp["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut_lineage(rooted)
    best = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component")))
    classes = cut_lineage(rooted.join(best, "root").select("fp", "root", "component"))
    return own.join(classes, "fp")


def component_ids(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(docs, shingle, radius)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(real_id().alias("doc_id"), digits.alias("fingerprint"), real_id("component").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each group stays: the least id, then the least hash of the text.

    Null, empty and blank texts share fingerprint 0, so one of them stays. A null id is larger than every other, so
    such a row stays only where no row of its group has an id. Of equal rows one stays. An empty table gives an empty
    one. Other columns travel as one struct, so their names cannot clash.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        "text",
        F.xxhash64("text").alias("_t"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
    )
    found = near_duplicates(rows, shingle, radius, "_t")
    stay = cut_lineage(found.groupBy("root").agg(F.min(F.struct("doc_id", "_t")).alias("k"))).select("k.doc_id", "k._t")
    kept = rows.select("doc_id", "_t", "_row").join(stay, ["doc_id", "_t"], "left_semi")
    return kept.dropDuplicates(["doc_id", "_t"]).select("_row.*")
