"""A pipeline over ``documents``: language, near duplicates, benchmark passages, secrets, packed sequences.

Every stage takes all rows that its predecessor kept, as a table with the columns
of ``documents``, and what it decides takes effect. Nulls: a document without text
or without a letter has no language and goes, as does a row without an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import decontaminate, language, near, packing, secrets
from lorekeep.llm.scratch import written

#: Margin of the learned languages' best mixture over the background below which a text is in none of them: no better than it.
LEAST_MARGIN = 0.0


def _read(docs: DataFrame, decided: DataFrame, keep: str) -> DataFrame:
    """The rows of ``docs`` whose id fulfils ``keep``."""
    return docs.join(decided.where(keep).select("doc_id"), "doc_id", "left_semi").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; no letters, or no better explained by them than by letters without an order, and a document goes."""
    return language.accepted(docs.where("doc_id IS NOT NULL"), language.fit(docs), LEAST_MARGIN)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the one with the smallest id."""
    return _read(docs, near.near_duplicates(docs, width=5, percent=80), "kept")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _read(docs, found, "n_hit = 0")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the secrets' kinds; ``n_chars`` is that of the new text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with their ids."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("near_duplicates", near_stage),
    ("decontamination", benchmark_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Language models, signatures, automata and tokenizers are beyond SQL: tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
