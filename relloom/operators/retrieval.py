"""Exact retrieval over vectors, its evaluation, and negatives mined from it.

The queries are a stated set. They are packed in blocks and meet the corpus shard by shard: matrix products for each block and
shard, of which only k rows for each query leave the task. Neither side is ever broadcast or gathered whole. Blocks and shards
hold as many vectors as BYTES allow, so that each side is copied as seldom as a task's memory permits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import gain

BYTES, TILE = 16 << 20, 1024


def best_of(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k greatest values and of all that equal the k-th."""
    if sims.shape[1] <= k:
        return np.nonzero(np.isfinite(sims))
    kth = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k]
    return np.nonzero((sims >= kth[:, None]) & np.isfinite(sims))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, shard: int | None = None, block: int | None = None) -> DataFrame:
    """query_id, vec_id, sim, rank: the k best by inner product, ties to the smaller id; a query never finds itself.

    ``queries``: query_id long, vector array<float>; ``corpus``: vec_id long, vector array<float>. Where both have a column
    ``kind``, a query doesn't find vectors of its own kind. Null vectors take no part; vectors of different lengths raise.
    ``shard`` and ``block`` are the vectors of a part of either side, by default what fits in BYTES.
    """
    kinds = "kind" in queries.columns and "kind" in corpus.columns
    queries, corpus = (df if kinds else df.withColumn("kind", F.lit(None).cast("string")) for df in (queries, corpus))
    queries, corpus = queries.where("vector is not null"), corpus.where("vector is not null")
    many = corpus.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size")).first()
    fit = max(TILE, BYTES // (8 * max(many["size"] or 1, 1)))
    # a small corpus is still spread over the cluster's cores
    n_shards = max(1, -(-many["n"] // (shard or fit)), 0 if shard else min(corpus.sparkSession.sparkContext.defaultParallelism, many["n"] // TILE))
    n_blocks = max(1, -(-queries.count() // (block or fit)))
    asked = queries.select("query_id", "kind", F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    held = corpus.select("vec_id", "kind", F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def best(ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "sim": []}).astype({"query_id": "int64", "vec_id": "int64", "sim": "float64"})
        ids, held_vectors = rows.vec_id.to_numpy(), np.stack(rows.vector).T
        parts = []
        for at in range(0, len(ask), TILE):
            some = ask.iloc[at : at + TILE]
            sims = np.stack(some.vector) @ held_vectors
            sims[some.query_id.to_numpy()[:, None] == ids[None, :]] = -np.inf
            if kinds:
                sims[some.kind.to_numpy()[:, None] == rows.kind.to_numpy()[None, :]] = -np.inf
            q, c = best_of(sims, k)
            order = np.lexsort((ids[c], -sims[q, c], q))
            q, c = q[order], c[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k  # the place among the query's own
            parts.append(pd.DataFrame({"query_id": some.query_id.to_numpy()[q[keep]], "vec_id": ids[c[keep]], "sim": sims[q[keep], c[keep]]}))
        return pd.concat(parts)

    found = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInPandas(best, "query_id long, vec_id long, sim double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def graded(found: DataFrame, qrels: DataFrame) -> DataFrame:
    """``found`` with ``relevance``: the grade of (query_id, vec_id), 0 where there is none.

    ``qrels``: query_id, vec_id, relevance, and ``ord`` where a pair may be judged more than once; then the last one counts.
    """
    if "ord" in qrels.columns:
        qrels = qrels.groupBy("query_id", "vec_id").agg(F.max_by("relevance", "ord").alias("relevance"))
    return found.join(qrels, ["query_id", "vec_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def retrieval_ndcg(found: DataFrame, ideal: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg: DCG of graded ranks over the ideal of all judged documents; queries without any are left out.

    ``ideal``: query_id, idcg.
    """
    got = found.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain("relevance", "rank")).alias("dcg"))
    return ideal.where("idcg > 0").join(got, "query_id", "left").select("query_id", (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"))


def ideal_of_counts(counts: DataFrame, k: int = 10) -> DataFrame:
    """query_id, idcg from query_id, n: binary relevance with n relevant documents."""
    gains = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(i <= F.col("n"), 1 / F.log2(i + F.lit(1.0))).otherwise(F.lit(0.0)))
    return counts.select("query_id", F.aggregate(gains, F.lit(0.0), lambda a, x: a + x).alias("idcg"))


def negatives(found: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """Top k first, then without positives: at most k for each query."""
    return found.where(F.col("rank") <= k).join(positives, ["query_id", "vec_id"], "left_anti")


def negatives_after(found: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """Without positives first, then the top k; ``found`` must reach k past the query's positives."""
    rank = Window.partitionBy("query_id").orderBy("rank")
    rest = found.join(positives, ["query_id", "vec_id"], "left_anti")
    return rest.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k).drop("rank").withColumnRenamed("n", "rank")


def positive_texts(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, pos_list: texts of positive ids in the judgements' order; missing ids are skipped, the last of equal ids counts.

    ``qrels``: query_id, doc_id, score, ord; ``corpus``: doc_id, text, ord.
    """
    last = corpus.groupBy("doc_id").agg(F.max_by("text", "ord").alias("text"))
    rows = qrels.where("score > 0").join(last, "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return rows.groupBy("query_id").agg(F.transform(ordered, lambda x: x["text"]).alias("pos_list"))
