"""The corpus pipeline: STAGES over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acopio.llm import language, near_dup, packing, quality, suffixes
from acopio.llm.shared import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with words of no clear one, go."""
    return language.keep(docs, language.fit(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under 0.3 go."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more the one with the smallest doc_id stays."""
    return near_dup.keep_one(docs, 80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go from the text."""
    return suffixes.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 4096 tokens."""
    return packing.best_fit(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("best_fit_packing", pack),
]

#: Learned models, token ids and matching of bytes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs).df()
    return docs
