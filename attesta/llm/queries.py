"""One query per operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import bpe, collocations, decontaminate, embedding_dedup, html_text, line_dedup, ngram_lm, phrases, prefix_trie, quality, sharding, simhash, suffix_array

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).drop("kept")


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def bpe_encode(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_file or public_tokenizers.path("word_bpe_49k.json"))


def shard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def decontaminate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def judge_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def score_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"))


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(_table(spark, sf_dir, "documents"))


def phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_phrases(_table(spark, sf_dir, "documents"))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": dedup_lines,
    "op2_simhash_near_dedup": simhash_near_dedup,
    "op3_bpe": bpe_encode,
    "op4_sharding": shard_groups,
    "op5_decontamination": decontaminate_documents,
    "op6_html_extraction": extract_html,
    "op7_lm_scoring": score_language,
    "op8_quality_rules": judge_quality,
    "op10_substring_dedup": phrase_dedup,
    "op9_suffix_array_dedup": suffix_array_dedup,
    "op11_phrase_collocation_mining": phrase_collocations,
    "op12_embedding_near_dedup": embedding_near_dedup,
    "op13_conversation_prefix_trie": conversation_trie,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op11_phrase_collocation_mining": collocations.oracle(),
    "op12_embedding_near_dedup": embedding_dedup.ORACLE,
    "op13_conversation_prefix_trie": prefix_trie.ORACLE,
}
