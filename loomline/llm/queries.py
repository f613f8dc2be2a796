"""The registered queries of the corpus operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, forest, jpeg, near, packing, pii, quality, resampling, secrets, substring, suffixes, toxicity, whitening
from .common import documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(documents(spark, sf_dir))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_substrings(documents(spark, sf_dir)).drop("kept_text")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_digests(documents(spark, sf_dir))


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN, keep_ids=False).drop("ids")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir), keep_bytes=False).drop("kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_substring": op2_substring,
    "op3_media": op3_media,
    "op4_near": op4_near,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_suffixes": op10_suffixes,
    "op11_whitening": op11_whitening,
    "op12_resampling": op12_resampling,
    "op13_forest": op13_forest,
}

ORACLES: dict[str, str] = {}
