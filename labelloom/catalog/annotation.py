"""Reviews, votes, label joins and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.catalog.entry import query
from labelloom.catalog.inputs import (
    RATERS,
    SQL_CLASSIFIED,
    SQL_SENTENCES,
    bare_sentences,
    classified,
    review_labels,
    sentences,
    table,
)
from labelloom.catalog.texts import sql_strip
from labelloom.functions.votes import row_vote, vote_by_group
from labelloom.operators import agreement as G
from labelloom.operators import distribution as D
from labelloom.operators import reviews as R
from labelloom.operators.ordinal import global_ordinal, keep_first, preview
from labelloom.plans import annotation as A
from labelloom.session import scratch_path
from labelloom.sources.review_text import BODY, END, write_review_text

KEY = list(R.REVIEW_KEY)

# The vote down a review: most votes, then neutral, then the label seen first.
SQL_VOTES = """
tally AS (
  SELECT title, review_id, label_m, count(*) AS n, min(sentence_id) AS first_id
  FROM bare WHERE label_m IS NOT NULL GROUP BY ALL
),
voted AS (
  SELECT title, review_id, label_m AS label_m_review FROM tally
  QUALIFY row_number() OVER (PARTITION BY title, review_id
    ORDER BY n DESC, CASE WHEN label_m = 1 THEN 0 ELSE 1 END, first_id) = 1
)
"""

SQL_REVIEWS = f"""
{SQL_SENTENCES}, {SQL_VOTES},
agreed AS (
  SELECT s.title, s.review_id, any_value(v.label_m_review) AS label_m_review,
         any_value(label_chatgpt_review) AS label_chatgpt_review,
         any_value(label_perplexity_review) AS label_perplexity_review,
         any_value(label_copilot_review) AS label_copilot_review,
         count(sentence_id) AS number_of_sentences
  FROM sent s LEFT JOIN voted v ON s.title = v.title AND s.review_id = v.review_id
  GROUP BY s.title, s.review_id
)
"""


def sql_row_vote(cols: list[str], tie: str) -> str:
    votes = ", ".join(cols)
    best = f"""(SELECT {{pick}} FROM (
        SELECT v, count(*) AS n, min(i) AS i, max(count(*)) OVER () AS top
        FROM (SELECT unnest([{votes}]) AS v, unnest(range(1, {len(cols) + 1})) AS i) WHERE v IS NOT NULL GROUP BY v) WHERE n = top)"""
    if tie == "neutral":
        return best.format(pick="CASE WHEN bool_or(v = 1) THEN 1 ELSE arg_min(v, i) END")
    return best.format(pick=f"CASE WHEN count(*) > 1 THEN {cols[0]} ELSE min(v) END")


def sql_kappa(raters: list[str], source: str = "agreed") -> str:
    r = len(raters)
    known = " AND ".join(f"{c} IS NOT NULL" for c in raters)
    return f"""(
      WITH votes AS (SELECT title, review_id, unnest([{', '.join(raters)}]) AS category FROM {source} WHERE {known}),
      matrix AS (SELECT title, review_id, category, count(*) AS n FROM votes GROUP BY ALL),
      item AS (SELECT title, review_id, (sum(n * n) - {r}) / ({r} * {r - 1.0}) AS p FROM matrix GROUP BY ALL),
      chance AS (SELECT sum(q * q) AS pe FROM (SELECT sum(n) / CAST(sum(sum(n)) OVER () AS DOUBLE) AS q FROM matrix GROUP BY category))
      SELECT count(*) AS samples, (avg(p) - any_value(pe)) / (1 - any_value(pe)) AS kappa FROM item, chance
    )"""


SQL_BAND = """CASE WHEN kappa < 0 THEN 'No agreement' WHEN kappa <= 0.2 THEN 'Slight agreement'
  WHEN kappa <= 0.4 THEN 'Fair agreement' WHEN kappa <= 0.6 THEN 'Moderate agreement'
  WHEN kappa <= 0.8 THEN 'Substantial agreement' ELSE 'Almost perfect agreement' END"""

MANUAL_AND_RATERS = ["label_m_review", *RATERS]


@query(
    "a10_agreement_summary",
    f"""WITH {SQL_REVIEWS}
        SELECT '{A.AI_ONLY}' AS comparison, 'review' AS level, samples, round(kappa, 4) AS kappa, {SQL_BAND} AS interpretation
        FROM {sql_kappa(RATERS)}
        UNION ALL
        SELECT '{A.MANUAL_AND_AI}', 'review', samples, round(kappa, 4), {SQL_BAND} FROM {sql_kappa(MANUAL_AND_RATERS)}""",
)
def agreement_summary(spark, folder):
    return A.measure_agreement(sentences(spark, folder))


@query(
    "a9_fleiss_kappa",
    f"""WITH {SQL_REVIEWS}
        SELECT 'raters' AS comparison, samples, '0,1,2' AS categories, round(kappa, 6) AS kappa, {SQL_BAND} AS interpretation
        FROM {sql_kappa(RATERS)}""",
)
def kappa(spark, folder):
    out = G.fleiss_kappa(A.review_agreement(sentences(spark, folder), RATERS), {"raters": RATERS})
    return out.select(
        "comparison",
        "samples",
        F.array_join(F.transform("categories", lambda c: c.cast("string")), ",").alias("categories"),
        F.round("kappa", 6).alias("kappa"),
        "interpretation",
    )


@query(
    "a8_rating_matrix",
    f"""WITH {SQL_REVIEWS}
        SELECT title, review_id, category, count(*) AS votes FROM (
          SELECT title, review_id, unnest([{', '.join(MANUAL_AND_RATERS)}]) AS category FROM agreed
          WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MANUAL_AND_RATERS)}) GROUP BY ALL""",
)
def matrix(spark, folder):
    return G.rating_matrix(A.review_agreement(sentences(spark, folder), RATERS), KEY, MANUAL_AND_RATERS)


@query("a3_review_agreement", f"WITH {SQL_REVIEWS} SELECT * FROM agreed")
def agreement_table(spark, folder):
    return R.review_agreement(sentences(spark, folder), RATERS)


@query(
    "a4_vertical_vote",
    f"""WITH {SQL_SENTENCES}, {SQL_VOTES}
        SELECT k.title, k.review_id, v.label_m_review FROM (SELECT DISTINCT title, review_id FROM bare) k
        LEFT JOIN voted v ON k.title = v.title AND k.review_id = v.review_id""",
)
def vertical_vote(spark, folder):
    return vote_by_group(bare_sentences(spark, folder), KEY, "label_m", "sentence_id", "label_m_review")


VOTE_COLUMNS = ["label_m", *RATERS]


@query(
    "a5_row_vote_neutral",
    f"WITH {SQL_SENTENCES} SELECT title, review_id, sentence_id, CAST({sql_row_vote(VOTE_COLUMNS, 'neutral')} AS INTEGER) AS label FROM sent",
)
def neutral_vote(spark, folder):
    return sentences(spark, folder).select(*KEY, "sentence_id", row_vote(VOTE_COLUMNS, "neutral").alias("label"))


@query(
    "a6_row_vote_priority",
    f"WITH {SQL_SENTENCES} SELECT title, review_id, sentence_id, CAST({sql_row_vote(VOTE_COLUMNS, 'priority')} AS INTEGER) AS label FROM sent",
)
def priority_vote(spark, folder):
    vote = row_vote(VOTE_COLUMNS, "priority", priority="label_m")
    return sentences(spark, folder).select(*KEY, "sentence_id", vote.alias("label"))


@query(
    "p09_final_label",
    f"""WITH {SQL_SENTENCES} SELECT * EXCLUDE (f), f AS label_final_after_agreement, f AS label
        FROM (SELECT sent.*, CAST({sql_row_vote(VOTE_COLUMNS, 'priority')} AS INTEGER) AS f FROM sent)""",
)
def final(spark, folder):
    return A.final_labels(sentences(spark, folder))


SQL_ASSEMBLED = f"""
{SQL_SENTENCES},
kept AS (SELECT * REPLACE ({sql_strip('text')} AS text) FROM bare WHERE {sql_strip('text')} <> ''),
{SQL_VOTES.replace('FROM bare', 'FROM kept')},
assembled AS (
  SELECT row_number() OVER (ORDER BY title, review_id) AS review_order, title, review_id, full_review,
         number_of_sentences, label_m_review
  FROM (SELECT title, review_id, string_agg(text, ' ' ORDER BY sentence_id) AS full_review,
               count(sentence_id) AS number_of_sentences FROM kept GROUP BY ALL)
  LEFT JOIN voted USING (title, review_id)
)
"""


@query("a2_assemble_reviews", f"WITH {SQL_ASSEMBLED} SELECT * FROM assembled")
def assembled(spark, folder):
    return R.assemble_reviews(bare_sentences(spark, folder))


@query("a2_high_sentence_numbers", f"WITH {SQL_ASSEMBLED} SELECT * FROM assembled")
def assembled_far(spark, folder):
    """Sentence numbers that cross many blocks of a review."""
    far = bare_sentences(spark, folder).withColumn("sentence_id", F.col("sentence_id") * 3001 + F.col("review_id") * 4095)
    return R.assemble_reviews(far)


@query(
    "k4_review_blocks",
    f"""WITH {SQL_ASSEMBLED} SELECT review_order,
          'REVIEW_ORDER: ' || review_order || chr(10) || 'TITLE: ' || title || chr(10) || 'REVIEW_ID: ' || review_id || chr(10)
          || 'NUMBER_OF_SENTENCES: ' || number_of_sentences || chr(10) || 'FULL_REVIEW:' || chr(10) || full_review || chr(10)
          || repeat('=', 80) || chr(10) AS block FROM assembled""",
)
def blocks(spark, folder):
    return R.review_blocks(R.assemble_reviews(bare_sentences(spark, folder)))


@query(
    "k4_review_text",
    f"""WITH {SQL_ASSEMBLED} SELECT CAST(sum(strlen('REVIEW_ORDER: ' || review_order || 'TITLE: ' || title || 'REVIEW_ID: ' || review_id
          || 'NUMBER_OF_SENTENCES: ' || number_of_sentences || 'FULL_REVIEW:' || full_review) + 88) AS BIGINT) AS bytes,
          count(*) AS reviews, CAST(sum(number_of_sentences) AS BIGINT) AS sentences FROM assembled""",
)
def text_export(spark, folder):
    """The size of the export from sentence rows, and the blocks that can be read back from it."""
    path = scratch_path(spark, "export")
    write_review_text(bare_sentences(spark, folder), path)
    files = spark.read.format("binaryFile").load([f"{path}/{BODY}", f"{path}/{END}"])
    # part files begin and end within reviews, but this line of a head is always whole
    lines = spark.read.text(f"{path}/{BODY}", lineSep="\n")
    counts = lines.select(F.regexp_extract("value", "^NUMBER_OF_SENTENCES: ([0-9]+)$", 1).try_cast("long").alias("n"))
    nothing = F.lit(None).cast("long")
    both = counts.select(nothing.alias("b"), "n").unionAll(files.select(F.col("length"), nothing))
    return both.agg(F.sum("b").alias("bytes"), F.count("n").alias("reviews"), F.sum("n").alias("sentences"))


@query(
    "j1_spread_labels",
    f"WITH {SQL_SENTENCES} SELECT b.*, r.* EXCLUDE (title, review_id) FROM bare b LEFT JOIN review_labels r ON b.title = r.title AND b.review_id = r.review_id",
)
def spread(spark, folder):
    return R.spread_labels(bare_sentences(spark, folder), review_labels(spark, folder))


@query(
    "j2_narrow_key",
    f"""WITH {SQL_SENTENCES}, one AS (SELECT * EXCLUDE (title) FROM review_labels
          QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY title) = 1)
        SELECT b.*, o.* EXCLUDE (review_id) FROM bare b LEFT JOIN one o ON b.review_id = o.review_id""",
)
def narrow(spark, folder):
    one = keep_first(review_labels(spark, folder), ["review_id"], ["title"]).drop("title")
    return R.spread_labels(bare_sentences(spark, folder), one, ["review_id"])


SQL_ORDINALS = """
seen AS (
  SELECT row_number() OVER (ORDER BY min(struct_pack(r := review_id, s := sentence_id)), title, review_id) AS review_order, title, review_id
  FROM bare GROUP BY title, review_id
),
given AS (
  SELECT row_number() OVER (ORDER BY title, review_id) AS review_order, review_id % 3 AS label
  FROM (SELECT DISTINCT title, review_id FROM bare)
),
numbered AS (SELECT row_number() OVER (ORDER BY doc_id) AS review_order, quality FROM labels)
"""


def _seen(spark, folder):
    return R.reviews_in_appearance_order(bare_sentences(spark, folder), ["review_id", "sentence_id"])


@query(
    "j3_attach_by_ordinal",
    f"WITH {SQL_SENTENCES}, {SQL_ORDINALS} SELECT review_order, title, review_id, label FROM seen JOIN given USING (review_order)",
)
def by_ordinal(spark, folder):
    """As many labels as reviews: anything else raises."""
    keys = R.distinct_reviews(bare_sentences(spark, folder))
    given = global_ordinal(keys, KEY, "review_order").select("review_order", (F.col("review_id") % 3).alias("label"))
    return R.attach_by_ordinal(_seen(spark, folder), given, "review_order")


@query(
    "j3_unequal_ordinals",
    f"WITH {SQL_SENTENCES}, {SQL_ORDINALS} SELECT review_order, title, review_id, quality FROM seen FULL JOIN numbered USING (review_order)",
)
def by_unequal_ordinal(spark, folder):
    labels = global_ordinal(table(spark, folder, "labels"), ["doc_id"], "review_order").select("review_order", "quality")
    return R.attach_by_ordinal(_seen(spark, folder), labels, "review_order", strict=False)


@query(
    "distribute_labels",
    f"""WITH {SQL_SENTENCES}, j AS (
          SELECT b.*, r.* EXCLUDE (title, review_id) FROM bare b LEFT JOIN review_labels r ON b.title = r.title AND b.review_id = r.review_id)
        SELECT j.*, CAST({sql_row_vote(VOTE_COLUMNS, 'priority')} AS INTEGER) AS label FROM j""",
)
def distributed(spark, folder):
    return A.distribute_labels(sentences(spark, folder), review_labels(spark, folder))


@query("a12_distinct_reviews", f"WITH {SQL_SENTENCES} SELECT DISTINCT title, review_id FROM bare")
def distinct(spark, folder):
    return R.distinct_reviews(bare_sentences(spark, folder))


@query(
    "a12_keep_first",
    f"WITH {SQL_SENTENCES} SELECT * FROM bare QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY title, sentence_id) = 1",
)
def first_rows(spark, folder):
    return keep_first(bare_sentences(spark, folder), ["review_id"], ["title", "sentence_id"])


@query("f7_label_cardinality", """SELECT r AS reviews, l AS labels, r = l AS matches FROM
    (SELECT count(*) AS r FROM (SELECT DISTINCT role, conv_id FROM conversations)), (SELECT count(*) AS l FROM labels)""")
def cardinality(spark, folder):
    return R.label_cardinality(R.distinct_reviews(bare_sentences(spark, folder)), table(spark, folder, "labels"))


@query(
    "f8_unmatched_count",
    f"WITH {SQL_SENTENCES} SELECT count(*) AS unmatched FROM bare b ANTI JOIN review_labels r ON b.title = r.title AND b.review_id = r.review_id",
)
def unmatched_count(spark, folder):
    return R.unmatched_count(bare_sentences(spark, folder), review_labels(spark, folder))


@query(
    "f8_unmatched_sample",
    f"""WITH {SQL_SENTENCES} SELECT title, review_id, sentence_id, text FROM bare b
        ANTI JOIN review_labels r ON b.title = r.title AND b.review_id = r.review_id
        ORDER BY title, review_id, sentence_id LIMIT 20""",
)
def unmatched_sample(spark, folder):
    lost = R.unmatched(bare_sentences(spark, folder), review_labels(spark, folder))
    return preview(lost, [*KEY, "sentence_id"], 20).select(*KEY, "sentence_id", "text")


@query("w1_sorted_sentences", f"WITH {SQL_SENTENCES} SELECT * FROM bare ORDER BY title, review_id, sentence_id")
def in_order(spark, folder):
    return bare_sentences(spark, folder).orderBy(*KEY, "sentence_id")


@query(
    "w2_review_order",
    f"WITH {SQL_SENTENCES} SELECT row_number() OVER (ORDER BY title, review_id) AS review_order, title, review_id FROM (SELECT DISTINCT title, review_id FROM bare)",
)
def ordinals(spark, folder):
    reviews = R.distinct_reviews(bare_sentences(spark, folder))
    return global_ordinal(reviews, KEY, "review_order").select("review_order", *KEY)


@query("w3_preview", f"WITH {SQL_SENTENCES} SELECT * FROM bare ORDER BY title, review_id, sentence_id LIMIT 10")
def first_ten(spark, folder):
    return preview(bare_sentences(spark, folder), [*KEY, "sentence_id"], 10)


@query(
    "a1_label_distribution",
    f"""WITH {SQL_SENTENCES} SELECT k.label, count(b.label_m) AS count
        FROM (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS label) k LEFT JOIN bare b ON b.label_m = k.label GROUP BY k.label""",
)
def label_counts(spark, folder):
    return D.label_distribution(bare_sentences(spark, folder), "label_m")


@query(
    "a11_class_weights",
    f"""WITH {SQL_CLASSIFIED}, w AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * CAST(count(*) AS DOUBLE)) AS weight FROM cls GROUP BY label)
        SELECT doc_id, cls.label, round(weight, 6) AS weight FROM cls JOIN w USING (label)""",
)
def weights(spark, folder):
    df = classified(spark, folder).select("doc_id", "label")
    return D.with_class_weights(df).select("doc_id", "label", F.round("weight", 6).alias("weight"))


@query(
    "a14_row_counts",
    f"""WITH {SQL_SENTENCES} SELECT 'sentences' AS name, count(*) AS rows FROM bare
        UNION ALL SELECT 'reviews', count(*) FROM (SELECT DISTINCT title, review_id FROM bare)""",
)
def counts(spark, folder):
    df = bare_sentences(spark, folder)
    return D.row_counts(df, "sentences").unionByName(D.row_counts(R.distinct_reviews(df), "reviews"))
