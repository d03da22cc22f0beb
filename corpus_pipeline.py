"""A training-corpus pipeline: each stage applies one of the corpus operators to what its predecessor kept.

Language ID drops documents without any language, toxicity those scored toxic, the n-gram Jaccard join all but the
smallest document of each group, PII replaces personal data by its kind, and packing deals tokens into sequences.
Near duplicates are documents whose five-word shingles agree in at least 80 of 100.

Defined cases: null and empty texts, and those without a letter, have no language and go in the first stage; repeated
rows are copies, of which the join keeps one; of rows that share a doc_id but differ, the first in the order of their
columns stays; rows without a doc_id can't be told apart and all stay; texts of any length are taken whole; columns
beside doc_id and text are carried under names of their own, so no name can clash; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bestfit, group_jaccard, hyperlang, pii_bootstrap, toxic_knn
from tallyloom.llm.common import id_remainder, table, written
from tallyloom.llm.queries import tokenizer_path

WIDTH, PERCENT = 5, 80


def carried(docs: DataFrame, act: Callable[..., DataFrame]) -> DataFrame:
    """``act(docs, *others)`` with the columns beside doc_id and text under names that cannot clash, and then restored."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    hidden = [f"carried_{i}" for i in range(len(others))]
    done = act(docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(h) for c, h in zip(others, hidden))), *hidden)
    names = dict(zip(others, hidden))
    return done.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language."""
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    langs, matrix = hyperlang.load_prototypes(hyperlang.prototypes(docs, ~held_out))
    return carried(docs, lambda d, *keep: hyperlang.predict(d, langs, matrix, "text", *keep).where("lang_pred <> 'und'"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is below one half."""
    index = toxic_knn.fit(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 5) != 0)
    return carried(docs, lambda d, *keep: toxic_knn.score(d, index, 11, "text", *keep).where("score < 0.5"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each component, and one row of it; texts are shuffled once."""
    kept = group_jaccard.join_components(docs, WIDTH, PERCENT).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.join(kept.hint("merge"), "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"))
    first = rows.groupBy("doc_id").agg(F.min("row").alias("row")).select("row.*")
    return first.unionByName(docs.where("doc_id is null")).select(docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with personal data replaced."""
    return carried(docs, pii_bootstrap.redact)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals all tokens into sequences: one row per piece of a document."""
    return bestfit.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", known_language),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
