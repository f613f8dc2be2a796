"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; all but the last return
the columns of documents. Part of the corpus operators: __spark_entry__ does without it if it is not there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomline.llm import near, packing, pii, quality, substring
from loomline.llm.common import documents, forget, settle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality.keep_good(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: the one with the smallest id."""
    return near.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand earlier go from the texts; every document stays."""
    return substring.strip_text(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is packed: one row a piece."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("near", near_stage), ("substring", substring_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: SQL cannot express the tokeniser and the trained span classifier; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each stage's result is written and read again."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
