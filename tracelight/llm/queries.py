"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelight.llm import bag_minhash, licenses, line_dedup, oracles, pii, pivot_topk, poisson_mix, pstable, resample, sparse_suffix, tree_bpe
from tracelight.llm.kit import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.linked_vectors(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.select("doc_id", "log_weight", "n_features", "draw")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mixed(table(spark, sf_dir, "documents"), oracles.WEIGHTS, numbered=True)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_boilerplate(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_embedding_near_dedup, op2_pii, op3_byte_bpe, op4_suffix_dedup, op5_license_scan, op6_quality_resampling, op7_exact_topk, op8_minhash_near_dedup, op9_mixing, op10_line_dedup)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
