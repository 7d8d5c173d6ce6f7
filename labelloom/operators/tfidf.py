"""TF-IDF as a long (document, term, weight) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.text import bind
from labelloom.operators.bounded import BROADCAST_ROWS

#: A character that no token holds.
_BETWEEN = "\x00"


def smooth_idf(documents: Column, df: Column | str) -> Column:
    """ln((1 + n) / (1 + df)) + 1."""
    df = F.col(df) if isinstance(df, str) else df
    return F.log((1 + documents) / (1 + df)) + 1


def _runs(tokens: Column) -> Column:
    """(term, tf) of each distinct term of an array."""

    def lengths(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))

        def runs(h: Column) -> Column:
            after = lambda k: F.coalesce(F.get(h, k + 1), F.size(s) + 1)
            return F.transform(
                h, lambda i, k: F.struct(F.get(s, i - 1).alias("term"), (after(k) - i).cast("long").alias("tf"))
            )

        return bind(heads, runs)

    # not array_sort: its comparator is a lambda, which costs more than all the rest
    known = F.sort_array(F.array_compact(tokens))
    return bind(known, lambda s: F.when(F.size(s) > 0, lengths(s)))


def term_frequency(df: DataFrame, tokens: Column, doc: str, sublinear: bool = False) -> DataFrame:
    """(doc, term, tf, weight): occurrences per document (row); ``sublinear`` weighs 1 + ln(tf).

    Nothing is shuffled: a row's sorted terms fall into runs, and a run's length is the count.
    """
    counts = df.select(doc, F.explode(_runs(tokens)).alias("_r")).select(doc, "_r.term", "_r.tf")
    weight = F.log(F.col("tf").cast("double")) + 1 if sublinear else F.col("tf").cast("double")
    return counts.withColumn("weight", weight)


def idf_table(vocabulary: DataFrame, documents: int) -> DataFrame:
    """(term, idx, df, idf) for a vocabulary counted over ``documents`` documents."""
    return vocabulary.select("term", "idx", "df", smooth_idf(F.lit(documents), "df").alias("idf"))


def count_model(terms: Sequence[str], input_col: str, output_col: str) -> CountVectorizerModel:
    """A vectoriser with the given terms, in their order.

    ``CountVectorizerModel.from_vocabulary`` sends the terms to the JVM one by one, which takes seconds;
    here they go in one string.
    """
    jvm = SparkContext.getOrCreate()._jvm
    listed = jvm.java.util.regex.Pattern.compile(_BETWEEN).split(_BETWEEN.join(terms), -1)
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", listed)
    return model.setInputCol(input_col).setOutputCol(output_col)


def tfidf(
    df: DataFrame,
    tokens: Column,
    doc: str,
    idf: DataFrame,
    size: int,
    sublinear: bool = False,
) -> DataFrame:
    """(doc, term, idx, tf, weight): rows of a document have Euclidean norm 1.

    A vocabulary of up to ``BROADCAST_ROWS`` terms goes to the tasks: each row's terms become a sparse
    vector of counts, weights and norm are worked out in the row, and only then are the entries listed.
    Nothing of the text is shuffled and it is tokenised once. A larger vocabulary meets the (document,
    term) counts in a join.
    """
    if size > BROADCAST_ROWS:
        return _tfidf_by_join(df, tokens, doc, idf, sublinear)
    known = sorted(idf.select("idx", "term", "idf").collect(), key=lambda r: r["idx"])
    if not known:
        return _tfidf_by_join(df, tokens, doc, idf, sublinear)
    terms = F.coalesce(F.array_compact(tokens), F.array().cast("array<string>"))
    counter = count_model([r["term"] for r in known], "_terms", "_counts")
    scale = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in known]), inputCol="_counts", outputCol="_scaled")
    vectors = scale.transform(counter.transform(df.select(doc, terms.alias("_terms"))))
    entries = F.arrays_zip(
        F.unwrap_udt("_counts")["indices"].alias("idx"),
        F.unwrap_udt("_counts")["values"].alias("tf"),
        F.unwrap_udt("_scaled")["values"].alias("w"),
    )

    def damped(e: Column) -> Column:
        # the scaled count is tf * idf; damping puts 1 + ln(tf) in the place of tf
        weight = e["w"] / e["tf"] * (F.log(e["tf"]) + 1) if sublinear else e["w"]
        return F.struct(e["idx"].alias("idx"), e["tf"].cast("long").alias("tf"), weight.alias("w"))

    def unit(es: Column) -> Column:
        norm = F.sqrt(F.aggregate(es, F.lit(0.0), lambda total, e: total + e["w"] * e["w"]))
        return bind(norm, lambda n: F.transform(es, lambda e: F.struct(e["idx"].alias("idx"), e["tf"].alias("tf"), (e["w"] / n).alias("weight"))))

    rows = vectors.select(doc, F.inline(bind(F.transform(entries, damped), unit)))
    # at most ``size`` rows
    return rows.join(F.broadcast(idf.select("idx", "term")), "idx").select(doc, "term", "idx", "tf", "weight")


def _tfidf_by_join(df: DataFrame, tokens: Column, doc: str, idf: DataFrame, sublinear: bool) -> DataFrame:
    """For vocabularies too large for a task: (document, term) counts are joined and their norms aggregated."""
    counts = term_frequency(df, tokens, doc, sublinear).join(idf.select("term", "idx", "idf"), "term")
    raw = counts.select(doc, "term", "idx", "tf", (F.col("weight") * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return raw.select(doc, "term", "idx", "tf", (F.col("_w") / norm).alias("weight"))
