"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.byte_bpe import encode_bytes
from tidegauge.llm.common import read_table
from tidegauge.llm.compression import compress_vectors
from tidegauge.llm.fuzzy_lines import fuzzy_line_dedup
from tidegauge.llm.mixing import mix_documents
from tidegauge.llm.pii import find_personal_data
from tidegauge.llm.repetition import repetition_quality
from tidegauge.llm.resampling import resample_documents
from tidegauge.llm.secrets import scan_secrets
from tidegauge.llm.sentencepiece_bpe import encode_documents
from tidegauge.llm.sharding import shard_documents
from tidegauge.llm.simhash import simhash_components
from tidegauge.llm.unit_dedup import unit_dedup
from tidegauge.llm.vectors import vector_components


def model_path() -> str:
    """The BPE model of the contract; other callers give their own path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repetition_quality(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")


def op2_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_line_dedup(read_table(spark, sf_dir, "documents"), whole=True).drop("row_key")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op4_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(read_table(spark, sf_dir, "embeddings"))


def op5_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), model_path())


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents")).drop("row_number")


def op8_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup(read_table(spark, sf_dir, "documents")).drop("row_key")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_bytes(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_repetition_quality,
        op2_fuzzy_line_dedup,
        op3_secret_scan,
        op4_vector_near_dedup,
        op5_mix_to_weights,
        op6_sentencepiece,
        op7_feistel_shards,
        op8_line_hash_dedup,
        op9_personal_data,
        op10_simhash_near_dedup,
        op11_byte_bpe,
        op12_vector_codes,
        op13_importance_resampling,
    )
}
