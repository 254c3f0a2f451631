"""Documents to packed sequences: quality, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and gives a DataFrame that is
written as Parquet and read again as the next one's documents. All but the last give the columns of ``documents``.
Rows with null ids or texts, repeated rows and extra columns pass as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import disclosure, langid, neardup, packing, quality
from lodestone.llm.common import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network fitted on ``labels`` accepts."""
    return quality.accept(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose declared language cross-parsing doesn't contradict."""
    return langid.accept(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.dedup(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and what gives it away."""
    return disclosure.sanitised(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the ids that the SentencePiece codec gives each document go: (bin_id, doc_id, piece, start, length)."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn and hash, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's documents are deleted once the next one's are written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch()
    for name, stage in STAGES:
        now = Scratch()
        docs = now.keep(stage(spark, docs, sf_dir), name)
        last.drop()
        last = now
    return docs
