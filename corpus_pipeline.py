"""The corpus pipeline: quality filter, near-duplicate removal, mixing, encoding."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import bpe, mixing, neardup, quality
from gristmill.llm.common import free_name, kept, table


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (a similarity of 0.8 or more) stays, that of the smallest doc_id."""
    return neardup.keep_first(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned out towards the square root of their size; all rows are shuffled."""
    own = {c: free_name(docs, f"own{c}") for c in docs.columns if c.startswith("__")}  # mix() gives columns of such names
    mixed = mixing.mix(docs.withColumnsRenamed(own)).withColumnsRenamed({c: f"mixed{c}" for c in ("__rate", "__replica", "__key")})
    return mixed.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and digests of them and of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=tuple(c for c in docs.columns if c != "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", filter_quality),
    ("minhash_near_dedup", remove_near_duplicates),
    ("mixing_sources", mix_sources),
    ("byte_bpe", encode),
]
#: SQL can express neither the classifier nor the encoding; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each reading what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept(docs, f"pipeline-{name}")
    return docs
