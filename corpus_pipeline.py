"""A training-data pipeline over ``documents``: language, quality, near-duplicates, benchmark contamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's ``docs``.
All but the last return whole rows of ``documents``, so whatever columns it has go through; rows with null id stay unless a
stage rejects their text, and of rows that share an id one of each set of shingles stays after the near-duplicate stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from relloom.llm import bpe, decontam, langid, neardup, quality
from relloom.llm.common import drop_table, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in no learned language go: those without a letter, and those that no profile fits (see ``langid.keep``)."""
    return langid.keep(docs, langid.train(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays; word 5-grams that are 80 percent the same link two documents."""
    return neardup.keep(docs, 80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as digests."""
    return bpe.digests(docs, bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("quality", good),
    ("near_duplicates", distinct),
    ("decontamination", uncontaminated),
    ("encoding", encoded),
]

#: The stages learn models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        if k:
            drop_table(before)
    return docs
