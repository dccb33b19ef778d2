"""The corpus pipeline: language, toxicity, near duplicates, benchmark leaks, then token ids.

Each stage works on all that its predecessor kept. All but the last return the columns of ``documents``.
Every row is judged by its own text, so ids may be null, repeat, or name different texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from timberline.llm import byte_bpe, decontamination, language_id, ngram_jaccard, toxicity
from timberline.llm.common import table
from timberline.session import configure, scratch_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or of no language clearly, go."""
    table(spark, sf_dir, "documents")
    return language_id.clear_rows(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clear_rows(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", known_language), ("toxicity", not_toxic), ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", no_benchmark), ("byte-level BPE", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
