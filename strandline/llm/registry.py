"""The queries of this subpackage and, where SQL can express one, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, exact_top_k, hard_negatives, language_id, lexical_search, mixing, parity_join, pii, secrets, substrings, suffix_array, token_counts
from .common import table
from .oracles import SQL


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.linked_components(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k.top_k(table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.label("base"), 256).alias("base_sha256"), secrets.label("spans").alias("spans"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _of_kind(kind: int):
    return lambda span: span["kind"] == kind


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.label("base"), 256).alias("base_sha256"), pii.label("spans").alias("spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_conversations(rows))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Columns of operators 6, 8, 9 and 10 that SQL can state, from the same operators.


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target")


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.predicted(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", (F.col("lang_pred") == language_id.UNKNOWN).alias("undetermined"))


def token_text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_token_counts(spark, sf_dir).select("doc_id", "n_bytes", (F.col("n_tokens") > F.col("n_bytes")).alias("more_tokens_than_bytes"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_pii(spark, sf_dir).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_decontamination, op2_ngram_jaccard_join, op3_exact_top_k, op4_substring_dedup, op5_suffix_array_dedup, op6_mixing, op7_secrets, op8_language_id, op9_token_counts, op10_pii,
        op11_hard_negatives, op12_chat_format, op13_lexical_search, mixing_targets, language_folds, token_text_bytes, pii_base_spans,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {name: SQL[name] for name in queries() if name in SQL}
