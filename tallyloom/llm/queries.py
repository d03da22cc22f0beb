"""The queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, bestfit, blob_ledger, chunk_bpe, group_jaccard, hyperlang, matroska, pii_bootstrap, projected_knn, quality_cascade, source_divergence, toxic_knn, whitening
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(table(spark, sf_dir, "documents"))


def op2_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_projected_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_knn.search(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperlang.identify(table(spark, sf_dir, "documents"))


def op5_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_jaccard.join_components(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_knn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.pii_report(table(spark, sf_dir, "documents"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blob_ledger.secret_report(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.quality_report(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_group_jaccard": group_jaccard.SQL, "op12_quality_cascade": quality_cascade.SQL, "op13_source_divergence": source_divergence.SQL}
