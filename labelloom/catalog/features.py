"""Vocabularies, id sequences and TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.catalog.entry import query
from labelloom.catalog.inputs import table
from labelloom.catalog.texts import sql_bigrams, sql_tokens, sql_words
from labelloom.functions.text import whitespace_tokens, with_bigrams, word_tokens
from labelloom.operators import tfidf as W
from labelloom.operators import vocabulary as V

TERMS = 20_000

SQL_TOKENS = f"tok AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)"
SQL_LONG = f"{SQL_TOKENS}, long AS (SELECT doc_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS pos FROM tok)"
SQL_VOCABULARY = f"""{SQL_LONG},
counted AS (SELECT token, count(*) AS n, min(struct_pack(d := doc_id, p := pos)) AS first_at FROM long GROUP BY token),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, first_at) + 1 AS INTEGER) AS id, n AS count
          FROM counted ORDER BY n DESC, first_at LIMIT {V.MAX_TOKENS})"""


def sql_terms(source: str = "documents") -> str:
    return f"""
    grams AS (SELECT doc_id, {sql_bigrams('t')} AS g FROM (SELECT doc_id, {sql_words('text')} AS t FROM {source})),
    pairs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(g) AS term FROM grams) GROUP BY ALL)
    """


SQL_TERMS = sql_terms()


def sql_features(min_df: int = 1, size: int = TERMS, source: str = "documents") -> str:
    return f"""{sql_terms(source)},
    stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM pairs GROUP BY term HAVING count(*) >= {min_df}),
    feats AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, tf, df
              FROM (SELECT * FROM stats ORDER BY tf DESC, term LIMIT {size}))"""


def _terms():
    return with_bigrams(word_tokens("text"))


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


def _vocabulary(spark, folder):
    return V.top_vocabulary(V.term_statistics(_docs(spark, folder), whitespace_tokens("text"), "doc_id"))


def _features(spark, folder, min_df=1, size=TERMS):
    return V.feature_vocabulary(V.term_statistics(_docs(spark, folder), _terms(), "doc_id"), size, min_df)


@query("t1_token_counts", f"WITH {SQL_LONG} SELECT token, count(*) AS count FROM long GROUP BY token")
def token_counts(spark, folder):
    return V.token_counts(_docs(spark, folder), whitespace_tokens("text"))


@query("t2_top_vocabulary", f"WITH {SQL_VOCABULARY} SELECT * FROM vocab")
def top_vocabulary(spark, folder):
    return _vocabulary(spark, folder)


@query("t3_feature_vocabulary", f"WITH {sql_features(2, 30_000)} SELECT * FROM feats")
def feature_vocabulary(spark, folder):
    return _features(spark, folder, min_df=2, size=30_000)


@query("t4_term_frequency", f"WITH {SQL_TERMS} SELECT doc_id, term, tf, round(1 + ln(tf), 6) AS weight FROM pairs")
def term_frequency(spark, folder):
    out = W.term_frequency(_docs(spark, folder), _terms(), "doc_id", sublinear=True)
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "t5_smooth_idf",
    f"WITH {sql_features()} SELECT term, idx, df, round(ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1, 6) AS idf FROM feats",
)
def smooth_idf(spark, folder):
    docs = _docs(spark, folder)
    out = W.idf_table(_features(spark, folder), docs.count())
    return out.withColumn("idf", F.round("idf", 6))


@query(
    "t6_tfidf",
    f"""WITH {sql_features()},
        w AS (SELECT doc_id, p.term, idx, p.tf, p.tf * (ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1) AS w
              FROM pairs p JOIN feats USING (term))
        SELECT doc_id, term, idx, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
)
def tfidf(spark, folder):
    docs = _docs(spark, folder)
    idf = W.idf_table(_features(spark, folder), docs.count())
    out = W.tfidf(docs, _terms(), "doc_id", idf, TERMS)
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "p13_encode",
    f"""WITH {SQL_VOCABULARY},
        found AS (SELECT doc_id, pos, coalesce(id, {V.UNKNOWN_ID}) AS id FROM long LEFT JOIN vocab USING (token) WHERE pos <= {V.SEQUENCE_LENGTH}),
        listed AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM found GROUP BY doc_id)
        SELECT tok.doc_id, list_aggregate(list_concat(coalesce(ids, []),
                 list_transform(range({V.SEQUENCE_LENGTH} - coalesce(len(ids), 0)), lambda i: {V.PAD_ID})), 'string_agg', ',') AS ids
        FROM tok LEFT JOIN listed ON tok.doc_id = listed.doc_id""",
)
def encode(spark, folder):
    out = V.encode(_docs(spark, folder), whitespace_tokens("text"), _vocabulary(spark, folder), "doc_id")
    return out.select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(
    "j4_token_lookup",
    f"""WITH {SQL_VOCABULARY}
        SELECT doc_id, count(id) AS known, count(*) - count(id) AS unknown, CAST(sum(coalesce(id, {V.UNKNOWN_ID})) AS BIGINT) AS id_sum
        FROM long LEFT JOIN vocab USING (token) GROUP BY doc_id""",
)
def token_lookup(spark, folder):
    found = V.lookup(_docs(spark, folder), whitespace_tokens("text"), _vocabulary(spark, folder), "doc_id")
    return found.groupBy("doc_id").agg(
        F.count("known_id").alias("known"),
        F.count_if(F.col("known_id").isNull()).alias("unknown"),
        F.sum("id").alias("id_sum"),
    )
