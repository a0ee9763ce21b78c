"""The queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, decontamination, jaccard_join, language_id, nn_descent, oracles, packing, quotation_links, substring_dedup, token_counts, wavelet
from .session import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.cut(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contamination(decontamination.benchmark_hits(docs, table(spark, sf_dir, "benchmark")))


def op4_wavelet_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_attention_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.scored(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"))


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("node")


def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation_links.conversations(table(spark, sf_dir, "conversations"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_benchmark_decontamination, op4_wavelet_token_ids, op5_attention_lm_scoring, op6_nn_descent, op7_cost_balanced_packing, op8_ngram_jaccard_join, op9_quotation_links, op10_token_counts)}
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP, "op3_benchmark_decontamination": oracles.DECONTAMINATION, "op8_ngram_jaccard_join": oracles.JACCARD_JOIN,
    "op9_quotation_links": quotation_links.ORACLE_SQL,
}
