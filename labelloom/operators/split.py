"""Stratified splits and folds without shuffling the rows.

Rows of a class are ordered by md5(seed:id). A part of a class is a range of that order, so it is
enough to find the few rows where one part ends and the next begins; the rows themselves are then
assigned by comparing hashes, in the scan. The input is evaluated twice: once for a narrow table of
class, id and hash, which is removed again, and once for the result. On the narrow table, sizes give the
quotas, a partial aggregate over hash buckets tells which bucket holds an end, and exact ranks are
counted inside those alone: a class with nearly all rows is no hot task. Membership depends only on
seed, label and id, whatever the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from labelloom.session import passing_table

MAX_CLASSES = 10_000
MAX_BRANCHES = 60
BUCKET_ROWS = 1_000_000
HASH_DIGITS = 32


def hash_key(id_col: str, seed: int) -> Column:
    """The shuffled position of a row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def class_sizes(df: DataFrame, label: str) -> dict:
    """Rows per class, on the driver; raises beyond ``MAX_CLASSES`` classes."""
    rows = df.filter(F.col(label).isNotNull()).groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label}")
    return {r[label]: r["count"] for r in sorted(rows, key=lambda r: r[label])}


def share_out(sizes: Mapping, draws: int) -> dict:
    """Split ``draws`` over classes in proportion: whole parts first, then the largest remainders
    (equal remainders by label)."""
    total = sum(sizes.values())
    whole = {k: n * draws // total for k, n in sizes.items()}
    left = draws - sum(whole.values())
    by_remainder = sorted(sizes, key=lambda k: (-(sizes[k] * draws % total), k))
    return {k: whole[k] + (1 if k in by_remainder[:left] else 0) for k in sizes}


def holdout_quotas(sizes: Mapping, held: float = 0.25, test: float = 0.8) -> dict:
    """Rows of each class for train, val and test: ``held`` is set aside, ``test`` of that tests."""
    total = sum(sizes.values())
    n_held = math.ceil(total * held)
    train = share_out(sizes, total - n_held)
    rest = {k: sizes[k] - train[k] for k in sizes}
    val = share_out(rest, n_held - math.ceil(n_held * test))
    return {k: {"train": train[k], "val": val[k], "test": rest[k] - val[k]} for k in sizes}


def fold_quotas(sizes: Mapping, folds: int = 5) -> dict:
    """Rows of each class per fold: classes laid end to end are dealt out to the folds in turn."""
    quotas, start = {}, 0
    for k, n in sizes.items():
        quotas[k] = {i: len(range((i - start) % folds, n, folds)) for i in range(folds)}
        start += n
    return quotas


def keyed(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """(k, i, h): class, id and shuffled position of every row with a class."""
    return df.filter(F.col(label).isNotNull()).select(
        F.col(label).alias("k"), F.col(id_col).alias("i"), hash_key(id_col, seed).alias("h")
    )


def assign(
    df: DataFrame,
    label: str,
    id_col: str,
    quotas: Mapping | Callable[[dict], Mapping],
    name: str,
    seed: int = 42,
    bucket_digits: int = 3,
) -> DataFrame:
    """Add ``name``: the part of each row, in the order and sizes of ``quotas[label]``; quotas may be a
    function of the class sizes.

    ``id_col`` must be unique. ``bucket_digits`` hex digits of the hash make the buckets
    (16**3 = 4096); one with an end and more than ``BUCKET_ROWS`` rows is split by as many digits
    again, so that ranks are only counted in buckets of bounded size, however large the class.
    """
    return place(df, label, id_col, quotas, name, seed, bucket_digits)[0]


def place(
    df: DataFrame,
    label: str,
    id_col: str,
    quotas: Mapping | Callable[[dict], Mapping],
    name: str,
    seed: int = 42,
    bucket_digits: int = 3,
) -> tuple[DataFrame, Mapping]:
    """``assign``, and the quotas."""
    with passing_table(keyed(df, label, id_col, seed), "keyed") as narrow:
        if callable(quotas):
            quotas = quotas(class_sizes(narrow, "k"))
        found = _part_ends(narrow, quotas, bucket_digits)
    cuts = {}
    for k, parts in quotas.items():
        names = [p for p, n in parts.items() if n]
        filled = list(accumulate(n for n in parts.values() if n))
        if names:
            cuts[k] = (names, [found[(k, r)] for r in filled[:-1]])
    rows = df.filter(F.col(label).isNotNull())
    here = F.struct(hash_key(id_col, seed).alias("h"), F.col(id_col).alias("i"))
    if sum(len(names) for names, _ in cuts.values()) <= MAX_BRANCHES:
        return rows.withColumn(name, _by_branches(rows, label, id_col, here, cuts)), quotas
    return _by_lookup(rows, label, id_col, here, cuts, name), quotas


def _by_branches(rows: DataFrame, label: str, id_col: str, here: Column, cuts: Mapping) -> Column:
    """The part as one expression, for few classes."""
    id_type = rows.schema[id_col].dataType
    whole = F.when(F.lit(False), F.lit(next(iter(cuts.values()))[0][0])) if cuts else F.lit(None)
    for k, (names, ends) in cuts.items():
        part = F.lit(names[-1])
        for p, (h, i) in reversed(list(zip(names, ends, strict=False))):
            end = F.struct(F.lit(h).alias("h"), F.lit(i).cast(id_type).alias("i"))
            part = F.when(here <= end, F.lit(p)).otherwise(part)
        whole = whole.when(F.col(label) == F.lit(k), part)
    return whole


def _by_lookup(rows: DataFrame, label: str, id_col: str, here: Column, cuts: Mapping, name: str) -> DataFrame:
    """The part from a broadcast table with one row per class, at most ``MAX_CLASSES``."""
    any_part = next(iter(cuts.values()))[0][0]
    schema = StructType(
        [
            StructField(label, rows.schema[label].dataType),
            StructField("_names", ArrayType(StringType() if isinstance(any_part, str) else IntegerType())),
            StructField(
                "_ends",
                ArrayType(StructType([StructField("h", StringType()), StructField("i", rows.schema[id_col].dataType)])),
            ),
        ]
    )
    table = rows.sparkSession.createDataFrame([(k, names, ends) for k, (names, ends) in cuts.items()], schema)
    passed = F.size(F.filter("_ends", lambda end: end < F.col("_here")))
    return (
        rows.withColumn("_here", here)
        .join(F.broadcast(table), label)
        .withColumn(name, F.get("_names", passed))
        .drop("_here", "_names", "_ends")
        .select(*rows.columns, name)
    )


def _part_ends(rows: DataFrame, quotas: Mapping, digits: int) -> dict:
    """(class, rank) -> (hash, id) of the row with that rank, for every inner end of a part."""
    wanted = sorted(
        {
            (k, sum(list(parts.values())[: i + 1]))
            for k, parts in quotas.items()
            for i in range(len(parts))
        }
    )
    wanted = [(k, r) for k, r in wanted if 0 < r < sum(quotas[k].values())]
    if not wanted:
        return {}
    spark, k_type = rows.sparkSession, rows.schema["k"].dataType.simpleString()

    # (class, bucket, rank, place in the bucket): buckets that are too large are split further
    wide, places, width = [(k, "", r, r) for k, r in wanted], {}, 0
    while wide:
        asked = F.broadcast(spark.createDataFrame(wide, f"k {k_type}, p string, r long, place long"))
        inside = rows.withColumn("p", F.substring("h", 1, width))
        if width:
            inside = inside.join(asked.select("k", "p").distinct(), ["k", "p"])
        width += digits
        counts = inside.groupBy("k", "p", F.substring("h", 1, width).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("k", "p").orderBy("b"))
        ladder = counts.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("n"))
        held = ladder.join(asked, ["k", "p"]).filter("below < place and place <= upto").collect()
        large = [x for x in held if x["n"] > BUCKET_ROWS and width < HASH_DIGITS]
        wide = [(x["k"], x["b"], x["r"], x["place"] - x["below"]) for x in large]
        places[width] = [(x["k"], x["b"], x["r"], x["place"] - x["below"]) for x in held if x not in large]

    found = {}
    for width, ends in places.items():
        if ends:
            # one row per end, so the broadcast is bounded by classes x parts
            sought = F.broadcast(spark.createDataFrame(ends, f"k {k_type}, b string, r long, place long"))
            bucket = rows.withColumn("b", F.substring("h", 1, width))
            inside = bucket.join(sought.select("k", "b").distinct(), ["k", "b"])
            ranked = inside.withColumn("place", F.row_number().over(Window.partitionBy("k", "b").orderBy("h", "i")))
            hits = ranked.join(sought, ["k", "b", "place"])
            found |= {(x["k"], x["r"]): (x["h"], x["i"]) for x in hits.collect()}
    return found


def stratified_split(df: DataFrame, label: str, id_col: str, seed: int = 42, held: float = 0.25, test: float = 0.8) -> DataFrame:
    """Add ``split``: train, val or test (75 / 5 / 20 by default) in the proportions of each class."""
    return assign(df, label, id_col, lambda sizes: holdout_quotas(sizes, held, test), "split", seed)


def stratified_folds(df: DataFrame, label: str, id_col: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: 0..folds-1, equal shares of each class."""
    return assign(df, label, id_col, lambda sizes: fold_quotas(sizes, folds), "fold", seed)
