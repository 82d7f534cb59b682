"""Corpus, queries and judgements of a retrieval benchmark, from folders of Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import title_text


@dataclass
class Benchmark:
    corpus: DataFrame  # doc_id, text
    queries: DataFrame  # query_id, text: only queries with a positive judgement
    qrels: DataFrame  # query_id, doc_id, score


def read(spark: SparkSession, root: str, split: str = "test") -> Benchmark:
    """corpus, queries and qrels folders; the qrels of ``split``, or of the first split there is."""
    corpus = spark.read.parquet(f"{root}/corpus")
    title = F.col("title") if "title" in corpus.columns else F.lit(None).cast("string")
    corpus = corpus.select(F.col("_id").alias("doc_id"), title_text(title, "text").alias("text"))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/qrels")
    splits = sorted(s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.isDirectory())
    folder = f"{root}/qrels/{split}" if split in splits else f"{root}/qrels/{splits[0]}" if splits else f"{root}/qrels"
    qrels = spark.read.parquet(folder).select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), "score")
    queries = spark.read.parquet(f"{root}/queries").select(F.col("_id").alias("query_id"), "text")
    judged = qrels.where("score > 0").select("query_id").distinct()
    return Benchmark(corpus, queries.join(judged, "query_id", "left_semi"), qrels)


def encoded(df: DataFrame, text: str, encoder, output: str = "vector") -> DataFrame:
    """Vectors by an injected encoder (a list of texts to a list of float lists), in Arrow batches."""
    import pandas as pd

    def run(parts):
        for part in parts:
            yield part.assign(**{output: pd.Series([list(map(float, v)) for v in encoder(part[text].tolist())], index=part.index)})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))]))


def shards(spark: SparkSession, pattern: str) -> DataFrame:
    """Numbered Parquet shards by a path pattern, nested types and all."""
    return spark.read.parquet(pattern)
