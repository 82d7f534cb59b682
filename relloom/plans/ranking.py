"""Queries on retrieval, negatives and reranker evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash01
from ..operators import evaluation, pairs, retrieval, sampling
from ..session import table
from . import fixtures as fx
from .fixtures import FOUND, NDCG, RERANK, h, md5, r6

K, DEEP = 10, 20


def retrieval_topk(spark, sf):
    return fx.found(spark, sf, K).select("query_id", "vec_id", "rank", r6("sim"))


def _ndcg(spark, sf):
    e = table(spark, sf, "embeddings")
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n"))
    counts = e.where("vec_id % 10 = 0").join(F.broadcast(sizes), "label").selectExpr("vec_id query_id", "n")
    return retrieval.retrieval_ndcg(fx.labelled(spark, sf, K), retrieval.ideal_of_counts(counts, K), K)


def retrieval_ndcg10(spark, sf):
    return _ndcg(spark, sf).select("query_id", r6("ndcg"))


def retrieval_mean_ndcg(spark, sf):
    return _ndcg(spark, sf).agg(F.round(F.avg("ndcg"), 6).alias("mean_ndcg"), F.count("*").alias("n"))


def hard_negatives_topk_then_filter(spark, sf):
    rows = fx.labelled(spark, sf, DEEP)
    return retrieval.negatives(rows, rows.where("relevance = 1").select("query_id", "vec_id"), DEEP).select("query_id", "vec_id", "rank")


def hard_negatives_filter_then_topk(spark, sf):
    """Positives are the vectors of the query's label, so the search leaves out its own kind."""
    e = table(spark, sf, "embeddings").selectExpr("vec_id", "embedding vector", "label kind")
    return retrieval.top_k(e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), e, DEEP).select("query_id", "vec_id", "rank")


def rerank_ndcg10(spark, sf):
    return evaluation.ndcg_by_query(fx.rerank(spark, sf), ["model", "query_id"], K).select("model", "query_id", r6("ndcg"))


def negative_sample(spark, sf):
    rows = fx.labelled(spark, sf, DEEP).withColumn("key", F.concat_ws(".", F.col("query_id").cast("string"), F.col("vec_id").cast("string")))
    chosen = sampling.first_of_groups(rows.where("relevance = 0"), ["query_id"], "key", "neg", 7)
    return rows.where("relevance = 1").unionByName(chosen).select("query_id", "vec_id", "relevance")


def query_subsample(spark, sf):
    q = table(spark, sf, "embeddings").where("vec_id % 10 = 0").selectExpr("vec_id query_id", "cast(vec_id / 10 as long) idx")
    return sampling.first_rows(q, "query_id", "sub", 20)


def _by_model(spark, sf):
    return evaluation.ndcg_by_query(fx.rerank(spark, sf), ["dataset", "model", "query_id"], K)


def eval_report_pivot(spark, sf):
    return evaluation.report(_by_model(spark, sf), ["rr1", "rr2"]).select("dataset", r6("rr1"), r6("rr2"))


def common_datasets(spark, sf):
    return evaluation.shared_datasets(fx.rerank(spark, sf), 2)


def eval_cache_upsert(spark, sf):
    rows = _by_model(spark, sf).select("model", "query_id", "ndcg")
    first = rows.where("model = 'rr1'").withColumn("ord", F.lit(0))
    later = rows.where("model = 'rr2' and query_id % 20 = 0").withColumn("ord", F.lit(1))
    return evaluation.latest(first.union(later), ["query_id"], "ord").select("query_id", "model", r6("ndcg"))


def pair_explode_mean_score(spark, sf):
    rows = fx.labelled(spark, sf, DEEP).withColumn("key", F.concat_ws(".", F.col("query_id").cast("string"), F.col("vec_id").cast("string")))
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", hash01("s2", "key").alias("a"), hash01("s25", "key").alias("b")))).alias("x"))
    lists = lists.select("query_id", *[F.col(f"x.{n}").alias(n) for n in ("vec_id", "a", "b")])
    return pairs.from_scored_lists(lists, ["query_id"], "vec_id", "a", "b").selectExpr("query_id", "pos", "document vec_id", "round(score, 6) score")


def scatter_scores(spark, sf):
    rows = fx.rerank(spark, sf).where("model = 'rr1'")
    answers = rows.where("score >= 0.1").select("query_id", "pos", "score")
    return evaluation.scattered(rows.drop("score"), answers, ["query_id"]).select("query_id", "pos", r6("score"))


QUERIES = {f.__name__: f for f in (retrieval_topk, retrieval_ndcg10, retrieval_mean_ndcg, hard_negatives_topk_then_filter, hard_negatives_filter_then_topk, rerank_ndcg10, negative_sample, query_subsample, eval_report_pivot, common_datasets, eval_cache_upsert, pair_explode_mean_score, scatter_scores)}

_RETRIEVED = FOUND + """,
sizes AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label),
ideal AS (SELECT vec_id AS query_id, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n) AS idcg FROM embeddings JOIN sizes USING (label) WHERE vec_id % 10 = 0),
got AS (SELECT query_id, sum(CASE WHEN relevance > 0 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM found WHERE rank <= 10 GROUP BY query_id),
scored_queries AS (SELECT query_id, coalesce(dcg, 0) / idcg AS ndcg FROM ideal LEFT JOIN got USING (query_id) WHERE idcg > 0)"""
_KEY = "concat(query_id, '.', vec_id)"

ORACLE_SQL = {
    "retrieval_topk": f"WITH {FOUND} SELECT query_id, vec_id, rank::INTEGER AS rank, round(sim, 6) AS sim FROM found WHERE rank <= 10",
    "retrieval_ndcg10": f"WITH {_RETRIEVED} SELECT query_id, round(ndcg, 6) AS ndcg FROM scored_queries",
    "retrieval_mean_ndcg": f"WITH {_RETRIEVED} SELECT round(avg(ndcg), 6) AS mean_ndcg, count(*) AS n FROM scored_queries",
    "hard_negatives_topk_then_filter": f"WITH {FOUND} SELECT query_id, vec_id, rank::INTEGER AS rank FROM found WHERE rank <= 20 AND relevance = 0",
    "hard_negatives_filter_then_topk": f"WITH {FOUND}, n AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM sims WHERE relevance = 0) SELECT query_id, vec_id, rank::INTEGER AS rank FROM n WHERE rank <= 20",
    "rerank_ndcg10": f"WITH {RERANK}, {NDCG} SELECT model, query_id, round(ndcg, 6) AS ndcg FROM ndcg",
    "negative_sample": f"WITH {FOUND}, top AS (SELECT * FROM found WHERE rank <= 20), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {md5('neg', _KEY)}, {_KEY}) AS k FROM top WHERE relevance = 0) SELECT query_id, vec_id, relevance FROM top WHERE relevance = 1 UNION ALL SELECT query_id, vec_id, relevance FROM n WHERE k <= 7",
    "query_subsample": f"SELECT vec_id AS query_id, vec_id // 10 AS idx FROM embeddings WHERE vec_id % 10 = 0 ORDER BY {md5('sub', 'vec_id')}, vec_id LIMIT 20",
    "eval_report_pivot": f"""WITH {RERANK}, {NDCG}, means AS (SELECT dataset, model, avg(ndcg) AS m FROM ndcg GROUP BY ALL)
        SELECT dataset::VARCHAR AS dataset, round(max(m) FILTER (model = 'rr1'), 6) AS rr1, round(max(m) FILTER (model = 'rr2'), 6) AS rr2 FROM means GROUP BY dataset
        UNION ALL SELECT 'AVERAGE', round(avg(m) FILTER (model = 'rr1'), 6), round(avg(m) FILTER (model = 'rr2'), 6) FROM means""",
    "common_datasets": f"WITH {RERANK} SELECT dataset FROM rerank GROUP BY dataset HAVING count(DISTINCT model) = 2",
    "eval_cache_upsert": f"""WITH {RERANK}, {NDCG}, rows AS (SELECT *, (model = 'rr2')::INTEGER AS ord FROM ndcg WHERE model = 'rr1' OR query_id % 20 = 0)
        SELECT query_id, arg_max(model, ord) AS model, round(arg_max(ndcg, ord), 6) AS ndcg FROM rows GROUP BY query_id""",
    "pair_explode_mean_score": f"WITH {FOUND} SELECT query_id, (rank - 1)::INTEGER AS pos, vec_id, round(({h('s2', _KEY)} + {h('s25', _KEY)}) / 2, 6) AS score FROM found WHERE rank <= 20",
    "scatter_scores": f"WITH {RERANK} SELECT query_id, pos::INTEGER AS pos, round(CASE WHEN score >= 0.1 THEN score ELSE 0 END, 6) AS score FROM rerank WHERE model = 'rr1'",
}
