"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, lm, merkle, ngram_join, oracles, pii, quality_model, quality_rules, secrets, substring_dedup, suffix_dedup, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents")).drop("rid")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.new_folder(spark)
    warc.write(_table(spark, sf_dir, "pages"), path)
    # responses by their inflated payloads, of which lengths and digests are taken anew; revisits, which have none, by their headers
    responses = warc.read(spark, path, payload=False, verify=True, where="record_type = 'response'")
    revisits = warc.read(spark, path, payload=False, where="record_type = 'revisit'")
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("rid")


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("rid")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_pii": op1_pii, "op2_language_model": op2_language_model, "op3_ngram_join": op3_ngram_join, "op4_suffix_dedup": op4_suffix_dedup, "op5_substring_dedup": op5_substring_dedup, "op6_warc": op6_warc, "op7_quality_rules": op7_quality_rules, "op8_quality_model": op8_quality_model, "op9_decontamination": op9_decontamination, "op10_bpe": op10_bpe, "op11_merkle": op11_merkle, "op12_whitening": op12_whitening, "op13_secrets": op13_secrets}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
