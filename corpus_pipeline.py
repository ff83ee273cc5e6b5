"""The corpus pipeline: language, near copies, benchmark passages, personal data, tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pitwall.llm import bpe, decontaminate, langid, ngram_join, pii
from pitwall.llm.common import stage, without
from pitwall.llm.queries import TOKENIZER, digests
from pitwall.session import remove_folder, staged_for_job, staging_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language is not told: no letters, or too narrow a margin."""
    return langid.accepted(docs, langid.learn(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of linked ones."""
    return ngram_join.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, stage(found.select("doc_id").distinct(), "decontam_found"), "doc_id")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows."""
    return pii.mask(docs, pii.learn(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left: doc_id, n_tokens and the digests of ids and text."""
    return digests(bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: No stage but the decontamination could be written in SQL; tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next.

    What a stage stages for itself goes when its result is written, and the table before
    goes with it; a stage that fails leaves the last finished table.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        path = staging_path(spark, f"pipeline_{name}")
        with staged_for_job(spark):
            out = function(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
