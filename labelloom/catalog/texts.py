"""Scalar functions and filters: cleaning, label parsing, schema helpers, tokenising."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.catalog.entry import query
from labelloom.catalog.inputs import SQL_CLASSIFIED, SQL_SENTENCES, classified, sentences, table
from labelloom.functions import labels as L
from labelloom.functions import schema as S
from labelloom.functions import text as T
from labelloom.operators.agreement import complete_ratings
from labelloom.plans.annotation import clean_sentences, clean_training_corpus

SPACES = f"[{T.SPACE}]+"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '\\A{SPACES}|{SPACES}\\z', '', 'g')"


def sql_clean(c: str) -> str:
    out = sql_strip(c)
    for pattern, new in ((T.URL_PATTERN, ""), (T.TAG_PATTERN, ""), (SPACES, " ")):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"nullif({out}, '')"


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '{SPACES}'), lambda t: t <> '')"


def sql_words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{T.WORD_PATTERN}')"


def sql_bigrams(c: str) -> str:
    return f"list_concat({c}, list_transform(range(1, len({c})), lambda i: {c}[i] || ' ' || {c}[i + 1]))"


@query("p01_clean_text", f"SELECT page_id, {sql_clean('html')} AS text FROM pages")
def clean_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.clean_text("html").alias("text"))


@query(
    "p02_clean_minimal",
    f"SELECT doc_id, coalesce({sql_strip('CASE WHEN doc_id % 10 <> 0 THEN text END')}, '') AS text FROM documents",
)
def minimal(spark, folder):
    some = F.when(F.col("doc_id") % 10 != 0, F.col("text"))
    return table(spark, folder, "documents").select("doc_id", T.clean_minimal(some).alias("text"))


@query("p03_strip", f"SELECT doc_id, {sql_strip(chr(39) + '  ' + chr(39) + ' || text || chr(160)')} AS text FROM documents")
def stripped(spark, folder):
    padded = F.concat(F.lit("  "), F.col("text"), F.lit(" "))
    return table(spark, folder, "documents").select("doc_id", T.strip(padded).alias("text"))


WORDS = "CASE n_chars % 7 WHEN 0 THEN ' Pozitivno ' WHEN 1 THEN 'positive' WHEN 2 THEN 'NEU' WHEN 3 THEN '0' WHEN 4 THEN 'neg' WHEN 5 THEN '2.0' ELSE 'bad' END"


@query(
    "p04_normalize_label",
    f"""SELECT doc_id, CAST(CASE lower(trim({WORDS}))
          WHEN 'negativno' THEN 0 WHEN 'negative' THEN 0 WHEN 'neg' THEN 0 WHEN '0' THEN 0
          WHEN 'neutralno' THEN 1 WHEN 'neutral' THEN 1 WHEN 'neu' THEN 1 WHEN '1' THEN 1
          WHEN 'pozitivno' THEN 2 WHEN 'positive' THEN 2 WHEN 'poz' THEN 2 WHEN '2' THEN 2 END AS INTEGER) AS label
        FROM documents""",
)
def label_words(spark, folder):
    return table(spark, folder, "documents").select("doc_id", L.normalize_label(F.expr(WORDS), strict=False).alias("label"))


NUMBERS = "CASE n_chars % 4 WHEN 0 THEN '1.7' WHEN 1 THEN 'x' WHEN 2 THEN CAST(n_chars AS STRING) ELSE NULL END"


@query(
    "p05_numeric_label",
    f"SELECT doc_id, CAST(trunc(TRY_CAST(({NUMBERS}) AS DOUBLE)) AS INTEGER) AS label FROM documents",
)
def numbers(spark, folder):
    return table(spark, folder, "documents").select("doc_id", L.int_label(F.expr(NUMBERS)).alias("label"))


@query("p06_normalize_header", "SELECT doc_id, lang FROM documents")
def header(spark, folder):
    raw = table(spark, folder, "documents").select(F.col("doc_id").alias(" Doc_ID "), F.col("lang").alias("LANG "))
    return S.normalize_header(raw)


@query("p07_find_column", f"WITH {SQL_CLASSIFIED} SELECT text, label FROM cls")
def columns_by_alias(spark, folder):
    df = classified(spark, folder)
    raw = df.select(F.col("text").alias("content"), F.col("prediction").alias("label"), F.col("label").alias("sentiment"))
    return S.text_and_label(raw)


@query("p08_drop_columns", f"WITH {SQL_SENTENCES} SELECT title, review_id, sentence_id, text, label_m FROM sent")
def drop_labels(spark, folder):
    return S.drop_stale_labels(sentences(spark, folder))


@query(
    "p10_whitespace_tokens",
    f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n, list_aggregate(t, 'string_agg', ' ') AS tokens
        FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)""",
)
def split_tokens(spark, folder):
    tokens = T.whitespace_tokens("text")
    return table(spark, folder, "documents").select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").alias("n"), F.nullif(F.array_join("t", " "), F.lit("")).alias("tokens")
    )


@query(
    "p11_word_tokens",
    f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n, list_aggregate(t, 'string_agg', ' ') AS tokens
        FROM (SELECT doc_id, {sql_words('text')} AS t FROM documents)""",
)
def words(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.word_tokens("text").alias("t")).select(
        "doc_id", F.size("t").alias("n"), F.nullif(F.array_join("t", " "), F.lit("")).alias("tokens")
    )


@query(
    "p12_bigrams",
    f"""SELECT doc_id, CAST(len(g) AS INTEGER) AS n, list_aggregate(g, 'string_agg', '|') AS terms
        FROM (SELECT doc_id, {sql_bigrams('t')} AS g FROM (SELECT doc_id, {sql_words('text')} AS t FROM documents))""",
)
def bigrams(spark, folder):
    grams = T.with_bigrams(T.word_tokens("text")).alias("g")
    return table(spark, folder, "documents").select("doc_id", grams).select(
        "doc_id", F.size("g").alias("n"), F.nullif(F.array_join("g", "|"), F.lit("")).alias("terms")
    )


@query(
    "p14_interpret_kappa",
    """SELECT vec_id, CASE WHEN k < 0 THEN 'No agreement' WHEN k <= 0.2 THEN 'Slight agreement'
         WHEN k <= 0.4 THEN 'Fair agreement' WHEN k <= 0.6 THEN 'Moderate agreement'
         WHEN k <= 0.8 THEN 'Substantial agreement' WHEN k > 0.8 THEN 'Almost perfect agreement'
         ELSE 'Undefined' END AS interpretation
       FROM (SELECT vec_id, CASE WHEN vec_id % 9 <> 0 THEN CAST(embedding[1] AS DOUBLE) * 4 END AS k FROM embeddings)""",
)
def bands(spark, folder):
    k = F.when(F.col("vec_id") % 9 != 0, F.get("embedding", F.lit(0)).cast("double") * 4)
    return table(spark, folder, "embeddings").select("vec_id", L.interpret_kappa(k).alias("interpretation"))


@query("p15_round", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 4) + 0.0 AS score FROM embeddings")
def rounded(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("score")
    )


@query(
    "p16_argmax",
    "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS prediction FROM embeddings",
)
def best_class(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", L.argmax("embedding").alias("prediction"))


@query(
    "f1_drop_empty_text",
    f"SELECT doc_id, t AS text FROM (SELECT doc_id, {sql_strip('CASE WHEN doc_id % 6 = 0 THEN chr(9) ELSE text END')} AS t FROM documents) WHERE t <> ''",
)
def non_empty(spark, folder):
    text = F.when(F.col("doc_id") % 6 == 0, F.lit("\t")).otherwise(F.col("text"))
    return table(spark, folder, "documents").filter(T.has_text(text)).select("doc_id", T.strip(text).alias("text"))


@query("f2_drop_null", f"WITH {SQL_SENTENCES} SELECT title, review_id, sentence_id, text, label_m FROM sent WHERE label_m IS NOT NULL AND text IS NOT NULL")
def known_label(spark, folder):
    df = sentences(spark, folder).select("title", "review_id", "sentence_id", "text", "label_m")
    return df.na.drop(subset=["text", "label_m"])


@query(
    "f3_clean_training_corpus",
    f"""WITH raw AS (SELECT doc_id, text, CASE n_chars % 6 WHEN 3 THEN '3' WHEN 4 THEN 'x' WHEN 5 THEN '1.0'
                          ELSE CAST(n_chars % 6 AS VARCHAR) END AS label FROM documents)
        SELECT doc_id, {sql_clean('text')} AS text, CAST(TRY_CAST(label AS DOUBLE) AS INTEGER) AS label
        FROM raw WHERE TRY_CAST(label AS DOUBLE) IN (0, 1, 2) AND {sql_clean('text')} IS NOT NULL""",
)
def training_corpus(spark, folder):
    raw = table(spark, folder, "documents").select(
        "doc_id",
        F.col("text").alias(" Text"),
        F.expr("CASE n_chars % 6 WHEN 3 THEN '3' WHEN 4 THEN 'x' WHEN 5 THEN '1.0' ELSE CAST(n_chars % 6 AS STRING) END").alias("LABEL"),
    )
    return clean_training_corpus(raw)


@query(
    "f4_complete_ratings",
    f"WITH {SQL_SENTENCES} SELECT title, review_id, sentence_id, label_m, label_chatgpt_review FROM sent WHERE label_m IS NOT NULL AND label_chatgpt_review IS NOT NULL",
)
def complete(spark, folder):
    df = sentences(spark, folder).select("title", "review_id", "sentence_id", "label_m", "label_chatgpt_review")
    return complete_ratings(df, ["label_m", "label_chatgpt_review"])




@query("f5_f6_guards", "SELECT doc_id, quality, toxic FROM labels")
def guarded(spark, folder):
    df = S.require_columns(table(spark, folder, "labels"), ["doc_id", "quality", "toxic"])
    return S.require_rows(df, "labels").select("doc_id", "quality", "toxic")


GUARDED = ("documents", "labels", "pages", "benchmark", "conversations")
NEEDED = ("doc_id", "text", "lang")
CORPORA = ("en", "hr")


def _listed(values: str) -> str:
    return f"'[' || string_agg(chr(39) || {values} || chr(39), ', ' ORDER BY place) || ']'"


SQL_COLUMNS = " UNION ALL ".join(
    f"SELECT '{t}' AS source, column_name AS name, row_number() OVER () AS place FROM (DESCRIBE {t})" for t in GUARDED
)
SQL_GUARDED = f"""WITH cols AS ({SQL_COLUMNS}),
    needed AS (SELECT name, name AS place FROM (VALUES {", ".join(f"('{n}')" for n in NEEDED)}) AS v(name)),
    missing AS (SELECT source, {_listed("needed.name")} AS names FROM needed, (SELECT DISTINCT source FROM cols) AS s
                WHERE NOT EXISTS (SELECT 1 FROM cols WHERE cols.source = s.source AND cols.name = needed.name) GROUP BY source),
    existing AS (SELECT source, {_listed("name")} AS names FROM cols GROUP BY source),
    found AS (SELECT lang, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY lang)
    SELECT existing.source, corpus,
           CASE WHEN missing.names IS NOT NULL THEN 'missing columns ' || missing.names || '; existing columns ' || existing.names
                WHEN coalesce(n, 0) = 0 THEN existing.source || ' ' || corpus || ' has no rows'
                ELSE 'passes' END AS verdict
    FROM existing CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in CORPORA)}) AS v(corpus)
    LEFT JOIN missing ON missing.source = existing.source LEFT JOIN found ON lang = corpus"""


@query("f5_f6_guards_refuse", SQL_GUARDED)
def refused(spark, folder):
    """What the guards say of each table as a corpus of one language: that it passes, lacks columns, or has no rows."""
    found = []
    for source in GUARDED:
        df = table(spark, folder, source)
        for corpus in CORPORA:
            try:
                known = S.require_columns(df, NEEDED).filter(F.col("text").isNotNull() & (F.col("lang") == corpus))
                S.require_rows(known, f"{source} {corpus}")
                found.append((source, corpus, "passes"))
            except ValueError as refusal:
                found.append((source, corpus, str(refusal)))
    return spark.createDataFrame(found, "source string, corpus string, verdict string")


@query(
    "a7_row_vote_median",
    f"""WITH {SQL_SENTENCES},
        v AS (SELECT title, review_id, sentence_id, text,
                     label_m AS a,
                     CASE WHEN review_id % 3 <> 1 THEN label_perplexity_review END AS b,
                     CASE WHEN review_id % 4 <> 1 THEN label_copilot_review END AS c FROM sent),
        voted AS (SELECT *, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b
                    ELSE CAST(trunc(list_aggregate([a, b, c], 'median')) AS INTEGER) END AS label FROM v)
        SELECT title, review_id, sentence_id, {sql_clean('text')} AS text, label FROM voted
        WHERE label IS NOT NULL AND {sql_clean('text')} IS NOT NULL""",
)
def median_vote(spark, folder):
    raw = sentences(spark, folder).select(
        "title",
        "review_id",
        "sentence_id",
        "text",
        "label_m",
        F.when(F.col("review_id") % 3 != 1, F.col("label_perplexity_review")).alias("label_perplexity"),
        F.when(F.col("review_id") % 4 != 1, F.col("label_copilot_review")).alias("label_copilot"),
    )
    return clean_sentences(raw).select("title", "review_id", "sentence_id", "text", "label")
