"""From raw documents to packed sequences: quality rules, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet
to the shared folder and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilework.llm import packing, pii, quality, simhash_pairs
from tilework.llm.common import saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weak supervision takes for good; null and empty texts are not, repeated rows are judged each, an empty table stays empty."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near duplicates: five-word shingles, similarity 0.8 or more.

    Texts without words, null ones too, are one class; repeated rows are copies; a
    null id stays only where a class has no other; an empty table stays empty.
    """
    return simhash_pairs.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; null texts stay null, repeated rows stay, an empty table stays empty."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 4096 tokens; a null text is its end alone, an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: Estimation, fingerprints and column generation are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
