"""A corpus from documents: languages, exact and near duplicates, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns a frame
that is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents.

Cases, in every stage: columns beside doc_id, text and lang pass through untouched, whatever their
names; rows without text go at the first stage, having no language; rows without doc_id are rows like
others, as are rows that share one; of equal or alike rows one stays; very long texts are whole rows
throughout; an empty table, or one whose rows all go, gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickspark.llm import langid, mixing, neardup, packing, stream_dedup
from tickspark.llm.common import documents, work_dir, written
from tickspark.llm.tokens import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with less than even odds for any, go."""
    return langid.keep_identified(docs, langid.fit(docs), least=0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stream_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group linked by a Jaccard of 0.8 or more over 5-word shingles."""
    return neardup.keep_one(docs, threshold=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("packing", packed)]

#: Classifiers, sketches and tokenizers aren't SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), work_dir(spark, "pipeline")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{path}/{name}")
    return docs
