"""The queries of this package by name, over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from matchbook.llm import (
    alignment,
    bpe,
    lines,
    nearest,
    oracle,
    phrases,
    quality,
    repeats,
    rlz,
    secrets,
    simhash,
    tiling,
    token_files,
    transducer,
)

#: Vocabulary of the queries that encode.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks, and one of another kind.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.write_and_read(_table(spark, folder, "documents"), VOCABULARY, end_id=2)


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return repeats.remove_spans(docs, repeats.repeated_spans(docs, size=400))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, min_docs=10, min_chars=1))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that stay, with the probabilities they were judged by."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    kept = quality.classify(docs, labels).filter("keep")
    return kept.select("doc_id", *(F.round(f"p_{t}", 6).alias(f"p_{t}") for t in quality.TARGETS))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(_table(spark, folder, "documents"), VOCABULARY)


def op6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    labels = simhash.near_duplicates(_table(spark, folder, "documents"), shingle=3, max_bits=3)
    return labels.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, folder, "documents")).drop("base")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that hold benchmark items, with the items and how much of each."""
    docs, benchmark = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return tiling.contaminated(docs, benchmark).select("doc_id", "item_id", "coverage", "tiles")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return rlz.remove_spans(docs, rlz.factors(docs, window=50))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return phrases.collocations(docs, max_words=3, min_count=10, share=50, top=2000)


def op12_transducer(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return transducer.round_trip(docs, RANKS, public_tokenizers.PATTERN)


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(_table(spark, folder, "documents"), VOCABULARY, PIECES).drop("groups")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_quality": op4_quality,
        "op5_bpe": op5_bpe,
        "op6_nearest": op6_nearest,
        "op7_simhash": op7_simhash,
        "op8_secrets": op8_secrets,
        "op9_decontamination": op9_decontamination,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_phrases": op11_phrases,
        "op12_transducer": op12_transducer,
        "op13_alignment": op13_alignment,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql() | ({"pipeline": sql} if (sql := corpus_pipeline.ORACLE_SQL) else {})
