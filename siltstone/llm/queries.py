"""One query per operator, with production parameters, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import (
    byte_pairs,
    crosswalk,
    decontamination,
    jaccard,
    language,
    mixing,
    pages,
    periodicity,
    personal,
    pivots,
    secrets,
    tokens,
    toxicity,
)
from siltstone.llm.shared import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(
        read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    )


def op3_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_vectors(read_table(spark, folder, "embeddings"))


def op4_tokens(spark: SparkSession, folder: str) -> DataFrame:
    settings = tokens.Settings(tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return tokens.token_digests(read_table(spark, folder, "documents"), settings)


def op5_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.gram_groups(read_table(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_documents(read_table(spark, folder, "documents"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_language(read_table(spark, folder, "documents"))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, folder, "documents"))


def op9_personal(spark: SparkSession, folder: str) -> DataFrame:
    return personal.find_personal_data(read_table(spark, folder, "documents"))


def op10_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_pages(read_table(spark, folder, "pages"))


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodicity.run_digests(read_table(spark, folder, "documents"))


def op12_crosswalk(spark: SparkSession, folder: str) -> DataFrame:
    settings = crosswalk.Settings(
        bytes_file=public_tokenizers.path("byte_bpe_50k.json"),
        pieces_file=public_tokenizers.path("piece_bpe_32k.model"),
    )
    return crosswalk.align_documents(read_table(spark, folder, "documents"), settings)


def op13_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    settings = byte_pairs.Settings(ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_pairs.encoding_digests(read_table(spark, folder, "documents"), settings)


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_pivots": op3_pivots,
    "op4_tokens": op4_tokens,
    "op5_jaccard": op5_jaccard,
    "op6_mixing": op6_mixing,
    "op7_language": op7_language,
    "op8_secrets": op8_secrets,
    "op9_personal": op9_personal,
    "op10_pages": op10_pages,
    "op11_runs": op11_runs,
    "op12_crosswalk": op12_crosswalk,
    "op13_byte_pairs": op13_byte_pairs,
}

ORACLES: dict[str, str] = {"op2_decontamination": decontamination.ORACLE}
