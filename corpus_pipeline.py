"""Stages that make a training set of the documents table, each on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontamination, jaccard, mixing, tokens, toxicity
from siltstone.llm.shared import read_table, write_shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _kept(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is wanted; a null id stays, as nothing speaks against it."""
    kept = wanted.select(F.col("doc_id").alias("wanted_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity network does not predict as toxic."""
    scores = toxicity.score_documents(docs, read_table(spark, folder, "labels"))
    return _kept(docs, scores.where("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group whose 5-word n-grams overlap: that with the smallest doc_id (of equal ids, one row).

    Rows without an id cannot be told apart and stay.
    """
    groups = jaccard.gram_groups(docs)
    kept = _kept(docs, groups.where("doc_id <=> component_id"))
    told = kept.withColumn("nameless", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return told.dropDuplicates(["doc_id", "nameless"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    found = decontamination.contamination(docs, read_table(spark, folder, "benchmark"))
    return _kept(docs, found.where("not contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The words that the mix takes: a row per document and pass through its source's blocks.

    A pass that takes all words of a document gives its whole text, another the taken words in order, one space between.
    """
    _, _, used = mixing.mix(docs)
    parts = (
        used.withColumn("pass", F.explode("passes"))
        .groupBy("doc_id", "source", "tie", "pass")
        .agg(
            F.sum(F.col("high") - F.col("low")).alias("taken"),
            F.max("size").alias("size"),
            F.sort_array(F.collect_list(F.struct("low", "high"))).alias("ranges"),
        )
    )
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = F.array_join(
        F.flatten(F.transform("ranges", lambda r: F.slice(F.col("words"), (r["low"] + 1).cast("int"), (r["high"] - r["low"]).cast("int")))), " "
    )
    parts = parts.toDF("part_id", "part_source", "tie", "pass", "taken", "size", "ranges")
    same = (
        F.col("doc_id").eqNullSafe(F.col("part_id"))
        & F.col("source").eqNullSafe(F.col("part_source"))
        & (F.xxhash64("text") == F.col("tie"))
    )
    return (
        docs.select(*COLUMNS)
        .join(parts, same)
        .withColumn("words", F.when(F.col("taken") < F.col("size"), words))
        .withColumn("text", F.when(F.col("taken") < F.col("size"), some).otherwise(F.col("text")))
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .select(*COLUMNS)
    )


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token files of the mix, and what reading them back gives for each document."""
    settings = tokens.Settings(tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return tokens.token_digests(docs, settings)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

# The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to shared storage and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
