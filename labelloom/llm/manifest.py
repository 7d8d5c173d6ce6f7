"""Merkle manifest of a dataset (operator 12): nodes labelled with nested intervals of leaf ranks.

Leaves are ranked over the whole table by source and id, so every node covers an interval of ranks:
a run of leaves, a whole source, all sources. A tree grows level by level: the bucket of a level is a
run of ``FANOUT`` neighbouring nodes, and their digests make the node above. On the way down the
buckets of each level are joined with the nodes that contain them, which hand on the path to the
root; the interval of a run less that of one of its nodes gives the siblings left and right of it. A
level has a sixteenth of the rows of the one below, no group has more than ``FANOUT`` rows, and no
source is ever in one task: a hot one is many runs. Paths travel once for each run, not for each leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.ordinal import global_ordinal
from labelloom.session import cut_lineage, settle

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Hexadecimal digits of a digest.
DIGITS = 64
STEP = "struct<left:string,right:string>"


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(fields: Sequence[Column | str] = FIELDS) -> Column:
    """The digest of a row: each field as its length in bytes, a colon and its value, a missing one as ``-``."""

    def spelled(field: Column | str) -> Column:
        text = (F.col(field) if isinstance(field, str) else field).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return sha256(*map(spelled, fields))


def fold(leaf: Column, path: Column | str) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda below, step: sha256(step["left"], below, step["right"]))


def siblings(path: Column | str) -> Column:
    """All siblings on a path, level by level, left to right, as one string of digests."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _grow(nodes: DataFrame, keep: Sequence[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs and finished trees by level.

    ``nodes``: (lo, hi, first, end, digest, *keep), a node covers the ranks from ``lo`` to before ``hi``
    of a tree that covers ``first`` to before ``end``. A run is labelled like the node that it becomes
    and lists its nodes in order; ``keep`` stays with the leaves.
    """
    runs, trees, width = [], [], 1
    widest = nodes.agg(F.max(F.col("end") - F.col("first"))).first()[0] or 0
    while True:
        whole = (F.col("lo") == F.col("first")) & (F.col("hi") == F.col("end"))
        trees.append(nodes.filter(whole))
        if width >= widest:
            return runs, trees
        wider = width * FANOUT
        bucket = F.col("lo") - (F.col("lo") - F.col("first")) % wider
        member = F.struct("lo", "hi", "digest", *keep)
        run = nodes.filter(~whole).groupBy(bucket.alias("lo"), "first", "end").agg(F.array_sort(F.collect_list(member)).alias("nodes"))
        run = run.withColumn("hi", F.least(F.col("lo") + wider, F.col("end")))
        run = run.withColumn("digests", F.array_join(F.transform("nodes", lambda n: n["digest"]), "")).drop("digest")
        runs.append(cut_lineage(run))
        nodes = runs[-1].select("lo", "hi", "first", "end", sha256(F.col("digests")).alias("digest"))
        width, keep = wider, ()


def _descend(runs: list[DataFrame], tops: list[DataFrame], facts: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(lo, path, *facts, *keep) for the leaves of all runs.

    ``tops``: by level, (lo, path, *facts) of the trees that end there. A run is joined with the node
    of its interval, and each of its nodes takes the rest of the interval as siblings.
    """
    here = None
    for level in reversed(range(len(runs))):
        above = tops[level + 1] if here is None else here.unionByName(tops[level + 1])
        run = runs[level].select("lo", "digests", "nodes").join(above, "lo")
        each = run.select("path", "digests", *facts, F.posexplode("nodes").alias("_at", "_node"))
        left = F.substring("digests", F.lit(1), F.col("_at") * DIGITS)
        right = F.substring("digests", (F.col("_at") + 1) * DIGITS + 1, F.lit(FANOUT * DIGITS))
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        kept = [F.col(f"_node.{c}").alias(c) for c in keep] if level == 0 else []
        here = each.select(F.col("_node.lo").alias("lo"), F.concat(step, "path").alias("path"), *facts, *kept)
    return here


def _no_steps() -> Column:
    return F.array().cast(f"array<{STEP}>")


def proofs(leaves: DataFrame) -> DataFrame:
    """One row for each leaf: its columns, its ``path`` (siblings left and right, level by level up to
    the root), the ``subroot`` of its source and the ``root``.

    ``leaves`` has source, doc_id and ``leaf``, a digest, and may have more columns. Leaves of a source
    stand in order of doc_id, a missing one first, equal ones by digest; sources in order of their
    bytes, a missing one first. Equal rows are leaves of their own. A source with one leaf has that as
    its subroot. An empty table gives an empty one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("row")
    # settled before the range sort, which reads its input twice: texts are hashed once
    settled = settle(leaves.select("source", "doc_id", F.col("leaf").alias("digest"), row), "leaves")
    ranked = global_ordinal(settled, ["source", "doc_id", "digest"], "lo")
    spans = ranked.groupBy(F.col("source").alias("_s")).agg(F.min("lo").alias("first"), (F.max("lo") + 1).alias("end"))
    nodes = ranked.join(spans, F.col("source").eqNullSafe(F.col("_s"))).select(
        "lo", (F.col("lo") + 1).alias("hi"), "first", "end", "digest", "row"
    )
    runs, trees = _grow(cut_lineage(nodes), ["row"])

    roots = [t.select(F.col("lo").alias("start"), F.lit(k).alias("level"), "digest") for k, t in enumerate(trees)]
    ordered = global_ordinal(reduce(DataFrame.unionByName, roots), ["start"], "lo")
    sources = ordered.count()
    facts = F.struct("start", "level", F.col("digest").alias("subroot")).alias("fact")
    high = ordered.select("lo", (F.col("lo") + 1).alias("hi"), F.lit(1).alias("first"), F.lit(sources + 1).alias("end"), "digest", facts)
    high_runs, high_trees = _grow(high, ["fact"])
    crown = [t.select("lo", _no_steps().alias("path"), F.col("digest").alias("root")) for t in high_trees]
    if high_runs:
        over = _descend(high_runs, crown, ["root"], ["fact"])
    else:
        over = high_trees[0].select(_no_steps().alias("path"), F.col("digest").alias("root"), "fact")
    over = cut_lineage(over.select("path", "root", "fact.start", "fact.level", "fact.subroot"))

    tops = [over.filter(F.col("level") == k).select(F.col("start").alias("lo"), "path", "subroot", "root") for k in range(len(trees))]
    alone = trees[0].select("lo", "row").join(tops[0], "lo")
    out = alone
    if runs:
        out = out.unionByName(_descend(runs, tops, ["subroot", "root"], ["row"]).select(alone.columns))
    return out.select("row.*", "path", "subroot", "root")


def tampered_digest(fields: Sequence[str] = FIELDS, text: str = "text") -> Column:
    """The digest of a row whose text had its letters A-Z lowered; missing texts stay missing."""
    upper = "".join(map(chr, range(65, 91)))
    return leaf_digest([F.translate(F.col(f), upper, upper.lower()) if f == text else f for f in fields])


def audit(docs: DataFrame, every: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A row is tampered with where ``every`` divides the CRC-32 of its id as text; rows without an id
    are left as they are. Its folded root is made from its present leaf and the siblings on file, so it
    differs from the root if the text had a letter to lower. Missing fields have a digest of their own
    (``-``), empty texts too (``0:``); other columns are ignored; repeated rows are leaves of their own.
    """
    number = F.col("doc_id").cast("long")
    plain = docs.select(number.alias("doc_id"), *[F.col(f).cast("string").alias(f) for f in FIELDS if f != "doc_id"])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    leaves = plain.select("source", "doc_id", leaf_digest().alias("leaf"), F.when(chosen, tampered_digest()).alias("now"))
    out = proofs(leaves).withColumn("folded_root", fold(F.coalesce("now", "leaf"), F.col("path")))
    return out.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings("path").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
