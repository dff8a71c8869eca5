"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, ngram_join, pii, quality_rules, text
from tidemark.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules (empty and null texts too) or lie outside go; an empty table stays empty."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: of the least doc_id, nulls last. Texts without words stay, once for each doc_id; an empty table stays empty."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which a benchmark item occurs go; null and empty texts and items match nothing, an empty table stays empty."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans are masked in text and n_chars follows; null texts stay null, all rows stay."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded of every row; null and empty texts have no ids and decode to ""."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("tokens", tokens)]

#: Robust outliers, graph scores and tokens aren't SQL; the tests hold each stage's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written and read again, so none is computed twice."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{text.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
