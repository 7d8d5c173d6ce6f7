"""The registered queries of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import language, leaks, lm, manifest, mixing, rules, secrets, simhash, substrings, suffixes, tokens, topk, turns
from labelloom.llm.twins import MANIFEST_SQL, TOP_K_SQL, TRIE_SQL

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    held = language.held_out(F.col("doc_id"), 7, 2)
    scores = lm.score_texts(docs, ~held)
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_digest(read(spark, folder, "documents"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.component_ids(read(spark, folder, "documents"))


def op4_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeat_digest(read(spark, folder, "documents"))


def op5_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leak_table(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(docs.filter(~held))
    return language.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(read(spark, folder, "documents"), tokens.Vocabulary.from_model(VOCABULARY))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality(read(spark, folder, "documents"))


def op10_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeat_digest(read(spark, folder, "documents"))


def op11_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(read(spark, folder, "embeddings"))


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.audit(read(spark, folder, "documents"))


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turns.trie(read(spark, folder, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scores,
        op2_secrets,
        op3_simhash,
        op4_substrings,
        op5_leaks,
        op6_language,
        op7_mix,
        op8_token_counts,
        op9_quality,
        op10_suffixes,
        op11_top_k,
        op12_manifest,
        op13_trie,
    )
}

ORACLE_SQL: dict[str, str] = {"op11_top_k": TOP_K_SQL, "op12_manifest": MANIFEST_SQL, "op13_trie": TRIE_SQL}
