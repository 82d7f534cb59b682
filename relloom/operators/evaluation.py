"""Reranker evaluation: score alignment, NDCG by query, caches and reports.

Candidates are in long form (dataset, model, query_id, pos, score, relevance), so a query of any length is a group-by.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import paired_filter
from ..functions.metrics import gain, ndcg
from ..session import exists


def ndcg_by_query(rows: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """keys, ndcg from long rows with pos, score and relevance: ties by pos, ideal among the candidates, 0 if none is relevant."""
    given = Window.partitionBy(*keys).orderBy(F.desc("score"), "pos")
    best = Window.partitionBy(*keys).orderBy(F.desc("relevance"), "pos")
    ranks = rows.withColumn("_r", F.row_number().over(given)).withColumn("_i", F.row_number().over(best))
    sums = ranks.where((F.col("_r") <= k) | (F.col("_i") <= k)).groupBy(*keys).agg(
        F.sum(F.when(F.col("_r") <= k, gain("relevance", "_r")).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("_i") <= k, gain("relevance", "_i")).otherwise(0.0)).alias("idcg")
    )
    return sums.select(*keys, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"))


def scattered(candidates: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with the score answered for their index; an index without an answer keeps 0."""
    return candidates.join(answers, [*keys, "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def latest(cache: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last entry of each key, all columns."""
    rest = [c for c in cache.columns if c not in keys]
    return cache.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def shared_datasets(results: DataFrame, models: int) -> DataFrame:
    """Datasets that every model has."""
    return results.groupBy("dataset").agg(F.countDistinct("model").alias("n")).where(F.col("n") == models).select("dataset")


def report(results: DataFrame, models: list[str]) -> DataFrame:
    """dataset by model means of ndcg, and an AVERAGE row over each model's datasets; columns: dataset and the models."""
    means = results.groupBy("dataset", "model").agg(F.avg("ndcg").alias("ndcg"))
    table = means.groupBy("dataset").pivot("model", models).agg(F.first("ndcg"))
    average = means.groupBy().pivot("model", models).agg(F.avg("ndcg")).select(F.lit("AVERAGE").alias("dataset"), *models)
    return table.select(F.col("dataset").cast("string").alias("dataset"), *models).union(average)


def evaluate(samples: DataFrame, done: DataFrame | None, scorer: Callable[[Column, Column], Column], k: int = 10) -> DataFrame:
    """idx, ndcg, scores, relevance of the samples that a cache doesn't hold.

    ``samples``: idx, query, documents array<string>, relevance array<double>; ``scorer`` maps (query, documents) to an array
    of scores, as a column: an expression or a pandas UDF. Blank documents go together with their relevance.
    """
    if done is not None:
        samples = samples.join(done.select("idx").distinct(), "idx", "left_anti")
    rows = samples.withColumn("x", paired_filter(F.col("documents"), F.col("relevance"))).where(F.size("x") > 0)
    rows = rows.select("idx", "query", F.transform("x", lambda x: x["document"]).alias("documents"), F.transform("x", lambda x: x["grade"]).alias("relevance"))
    rows = rows.withColumn("scores", scorer(F.col("query"), F.col("documents")))
    return rows.select("idx", ndcg(F.col("scores"), F.col("relevance"), k).alias("ndcg"), "scores", "relevance")


def samples_of(rows: DataFrame, negatives: int, seed: str) -> DataFrame:
    """idx, query, documents, relevance: all positives and at most ``negatives`` hash-chosen negatives of each row."""
    from ..functions.arrays import sampled

    chosen = sampled(F.col("neg_list"), negatives, seed, F.col("idx"))
    rows = rows.select("idx", "query", "pos_list", chosen.alias("neg"))
    grades = F.concat(F.transform("pos_list", lambda x: F.lit(1.0)), F.transform("neg", lambda x: F.lit(0.0)))
    return rows.select("idx", "query", F.concat("pos_list", "neg").alias("documents"), grades.alias("relevance"))


def rank_means(df: DataFrame, weighted: dict[str, str]) -> DataFrame:
    """One row: for each sum of a rank's losses, all ranks' sums over all their counts (at least one); 0 without any rows."""
    return df.agg(*[F.coalesce(F.sum(total) / F.greatest(F.sum(count).cast("double"), F.lit(1.0)), F.lit(0.0)).alias(total) for total, count in weighted.items()])


def run_over(spark, folder: str, names: list[str], read, scorer, cache: str, model: str, k: int = 10) -> DataFrame:
    """dataset, n, ndcg of each dataset and of all (the mean of the datasets' means, dataset null), with a cache for each.

    read: (path) to idx, query, documents, relevance; scorer as for ``evaluate``. Rows that a cache has aren't scored again.
    """
    if not names:
        raise FileNotFoundError(f"no dataset in {folder}")
    means = []
    for name in names:
        path = f"{cache}/{model}/{name}"
        done = spark.read.parquet(path) if exists(spark, path) else None
        fresh = evaluate(read(f"{folder}/{name}.jsonl"), done.select("idx") if done is not None else None, scorer, k)
        fresh.select("idx", "ndcg").write.mode("append").parquet(path)
        means.append(spark.read.parquet(path).groupBy("idx").agg(F.max("ndcg").alias("ndcg")).agg(F.lit(name).alias("dataset"), F.count("*").alias("n"), F.avg("ndcg").alias("ndcg")))
    every = reduce(DataFrame.unionByName, means)
    return every.union(every.agg(F.lit(None).cast("string"), F.sum("n"), F.avg("ndcg")))
