"""Corpus pipeline: quality, exact copies, near copies, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread
as the next stage's docs. All but the last return the columns of documents; the last adds ``copy``,
the number of the repetition that the mix takes of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxloom.llm import decontaminate, exact_dedup, jaccard_join, mixing, quality
from boxloom.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select_good(docs, quality.table_ratings(spark, sf_dir))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, ngram=5, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing sources to target weights", mix_sources),
]

#: The classifier of the first stage is trained; no SQL gives its rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
