"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import byte_bpe, decontamination, exact_dedup, language_id, quality, simhash, substring_dedup, token_counts, token_files, tool_calls
from tidelog.llm.common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.digest(documents(spark, sf_dir, "conversations"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest(documents(spark, sf_dir))


def queries() -> dict:
    import corpus_pipeline

    found = [
        op1_token_counts,
        op2_tool_calls,
        op3_token_files,
        op4_language_id,
        op5_quality,
        op6_simhash,
        op7_substring_dedup,
        op8_decontamination,
        op9_byte_bpe,
        op10_exact_dedup,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_tool_calls": tool_calls.SQL, "op7_substring_dedup": substring_dedup.SQL, "op8_decontamination": decontamination.SQL, "op10_exact_dedup": exact_dedup.SQL}
