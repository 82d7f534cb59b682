"""Exact top-k search by inner product with a KD-tree for each shard.

Shards are regions of space: a bounded sample is halved again and again at the median of its widest dimension, and every vector
goes down these splits. A region with more rows than a shard may hold, such as a third of the table in copies of one vector, is
dealt to several shards by the id's hash. Within a shard a tree goes on halving until a leaf is small; every node keeps the
tight box of its rows and its smallest id. No vector in a box can score more against a query than the sum over dimensions of the
better corner, so nodes are visited best bound first, and a search ends when the best bound left can't beat the k-th result, ids
breaking ties.

Trees are built once and written. The shards' own boxes (at most BOXES bytes; shards get larger before that is exceeded) are
broadcast. Each query first visits the NEAR shards with the best bounds, and then, with the k-th score it has found by then,
only those shards whose box can still reach it. Queries stream through a shard's tree; a shard with very many queries is read by
several tasks. So a shard's rows are moved once in each of the two rounds, however many queries there are, and a query is sent
where it may find something, no further.

Integers: floor(scale * x) with x as double. Sums are exact in float64 below 2**53; where they could exceed it Python's
integers are used, and a score beyond a long is held at the long's end. Vectors that are null, empty, or hold a null or
non-finite component take no part, nor do rows with a null id; rows that share an id count once (the shortest, then smallest
vector); queries and candidates of different lengths don't meet; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import pickle
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, materialize, scratch, small_batches

SCALE, K, EVERY = 256, 5, 50
#: Rows of a shard and of a leaf; shards that a query visits first; queries that one task takes through a shard.
SHARD, LEAF, NEAR, BLOCK = 4_096, 128, 2, 50_000
#: Bytes of all shards' boxes; vectors and bytes of the sample that the splits come from; its vectors for each region.
BOXES, SAMPLE, SAMPLE_BYTES, EACH = 64 << 20, 16_384, 32 << 20, 8
LEAST = np.iinfo(np.int64).min


class Tree:
    """Nodes in preorder: box, smallest id, and either two children or a slice of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high, self.first, self.span, self.children = [], [], [], [], []
        if len(ids):
            self.build(np.arange(len(ids)))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.exact: Tree | None = None

    def among(self, query: np.ndarray) -> tuple["Tree", np.ndarray]:
        """This tree and the query where float64 sums are exact, else both in Python's integers."""
        if self.rows.dtype == object or not fits(self.rows, query):
            if self.exact is None:
                self.exact = self if self.rows.dtype == object else Tree(self.ids, python_integers(self.rows))
            return self.exact, python_integers(query[None])[0]
        return self, query

    def build(self, at: np.ndarray) -> int:
        node, rows = len(self.first), self.rows[at]
        self.low.append(rows.min(axis=0))
        self.high.append(rows.max(axis=0))
        self.first.append(int(self.ids[at].min()))
        self.span.append(at)
        self.children.append(None)
        if len(at) > LEAF:
            widest = int((self.high[node] - self.low[node]).argmax())
            order = at[np.lexsort((self.ids[at], rows[:, widest]))]  # equal values in the order of ids
            middle = len(at) // 2
            self.children[node] = (self.build(np.sort(order[:middle])), self.build(np.sort(order[middle:])))
        return node

    def search(self, query: np.ndarray, own: int, k: int, best: list[tuple]) -> list[tuple]:
        """The k best (score, -id) of ``best`` and this tree's rows but the query's own, best first."""
        if not len(self.ids):
            return best
        bounds = np.maximum(self.low * query, self.high * query).sum(axis=1)
        heap = [(-bounds[0], self.first[0], 0)]
        while heap:
            bound, first, node = heappop(heap)
            if len(best) == k and (-bound, -first) <= best[-1]:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if len(best) < k or (bounds[child], -self.first[child]) > best[-1]:
                        heappush(heap, (-bounds[child], self.first[child], child))
                continue
            at = self.span[node]
            scores = self.rows[at] @ query
            if len(best) == k:
                some = scores >= best[-1][0]
                at, scores = at[some], scores[some]
            # ids ascend along ``at``, so a stable sort leaves ties to the smaller id; one more than k, as the own row may be there
            some = np.argsort(-scores, kind="stable")[: k + 1]
            found = [(scores[j], -int(self.ids[at[j]])) for j in some if self.ids[at[j]] != own]
            best = sorted(best + found, reverse=True)[:k]
        return best


def python_integers(rows: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in rows], object)


def fits(rows: np.ndarray, query: np.ndarray) -> bool:
    """Whether every partial sum of products is below 2**53."""
    return not rows.size or float(np.abs(rows).max()) * float(np.abs(query).max()) * rows.shape[1] < 2**53


def results(query: int, best: list[tuple], out: list[tuple]) -> None:
    ends = np.iinfo(np.int64)
    out += [(query, -other, int(min(max(score, ends.min), ends.max))) for score, other in best]


def splits(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of each node of a whole binary tree: a vector goes right where it is greater."""
    many = (1 << depth) - 1
    dims, values = np.zeros(many, np.int64), np.full(many, np.inf)
    held = {0: sample}
    for node in range(many):
        rows = held.pop(node)
        if len(rows):
            widest = int((rows.max(axis=0) - rows.min(axis=0)).argmax())
            order = np.sort(rows[:, widest])
            value = order[(len(rows) - 1) // 2]
            if value < order[-1]:  # else all are equal, and stay together
                dims[node], values[node] = widest, value
        right = rows[:, dims[node]] > values[node]
        held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
    return dims, values


def regions(rows: np.ndarray, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The region of each vector."""
    node = np.zeros(len(rows), np.int64)
    for _ in range(len(dims).bit_length()):
        node = 2 * node + 1 + (rows[np.arange(len(rows)), dims[node]] > values[node])
    return node - len(dims)


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the vectors that take part, an id once."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():  # ids alone are moved to tell
        return rows
    return rows.groupBy("vec_id").agg(F.min(F.struct(F.size("v").alias("n"), "v")).alias("x")).select("vec_id", "x.v")


def dealt(rows: DataFrame, shard_rows: int) -> DataFrame:
    """vec_id, v, shard, part: the shard is the region (or, for vectors of an unusual length, less than 0)."""
    spark = rows.sparkSession
    sizes = sorted(((r["count"], r["n"]) for r in rows.groupBy(F.size("v").alias("n")).count().collect()), reverse=True)
    many, size = sizes[0] if sizes else (0, 1)
    shard_rows = max(shard_rows, -(-many * size * 16 // BOXES))
    sampled = min(SAMPLE, SAMPLE_BYTES // (8 * size) + 1)
    depth = max(0, min(int(np.ceil(np.log2(max(many, 1) / shard_rows))) if many > shard_rows else 0, int(np.log2(max(sampled // EACH, 1)))))
    rank = F.xxhash64("vec_id")
    share = int(2.0**63 * min(1.0, 2.0 * sampled / max(many, 1))) - 2**62 if many > 2 * sampled else 2**63 - 1
    found = rows.where(F.size("v") == size).select(rank.alias("rank"), "v").where(F.col("rank") <= share).orderBy("rank").limit(sampled).select("v").collect() if depth else []
    dims, values = splits(np.array([r["v"] for r in found], np.float64).reshape(len(found), size), depth)
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("shard", pa.int32())])

    def place(batches):
        for b in batches:
            lists = b.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            shard = -lengths.astype(np.int64)
            usual = np.flatnonzero(lengths == size)
            if len(usual):
                shard[usual] = regions(lists.take(pa.array(usual)).flatten().to_numpy().reshape(-1, size), dims, values)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(shard.astype(np.int32))], schema=schema)

    placed = materialize(map_batches(rows, place, "vec_id long, v array<double>, shard int"))
    parts = placed.groupBy("shard").count().select(F.col("shard").alias("of"), F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))  # a row for each region
    placed = placed.join(F.broadcast(parts), F.col("shard") == F.col("of"))
    return placed.select("vec_id", "v", "shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int").alias("part"))


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[queries, boxes]: the most that a vector in each box can score, rounded up."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    most = up @ high.T + down @ low.T
    return most + 1e-9 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T)


ASKED = "query_id long, v array<double>, ids array<long>, scores array<long>"


def sent(queries: DataFrame, boxes, scale: int, k: int, first: bool) -> DataFrame:
    """The queries, once for each shard that they visit: the NEAR best ones, or the others that can still reach the k-th score."""
    schema = pa.schema([("query_id", pa.int64()), ("v", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64())), ("shard", pa.int32()), ("part", pa.int32())])

    def run(batches):
        by_size = boxes.value
        for b in batches:
            lengths = np.diff(b.column(1).offsets.to_numpy())
            for size in sorted(set(lengths.tolist())):
                if size not in by_size:
                    continue
                shard, part, low, high = by_size[size]
                mine = b.filter(pa.array(lengths == size))
                for at in range(0, mine.num_rows, 64):
                    some = mine.slice(at, 64)
                    asked = np.floor(scale * some.column(1).flatten().to_numpy().reshape(-1, size))
                    most = bounds(asked, low, high)
                    near = np.argsort(-most, axis=1, kind="stable")[:, :NEAR]
                    go = np.zeros(most.shape, bool)
                    if first:
                        np.put_along_axis(go, near, True, axis=1)
                    else:
                        kth = np.array([x[k - 1] if len(x) >= k else -np.inf for x in some.column(3).to_pylist()], np.float64)
                        go = most >= kth[:, None]  # a tie may hold a smaller id
                        np.put_along_axis(go, near, False, axis=1)
                    q, box = np.nonzero(go)
                    yield pa.RecordBatch.from_arrays([*some.take(pa.array(q)).columns, pa.array(shard[box], pa.int32()), pa.array(part[box], pa.int32())], schema=schema)

    return map_batches(queries.select("query_id", "v", "ids", "scores"), run, f"{ASKED}, shard int, part int")


def visited(asked: DataFrame, trees: DataFrame, scale: int, k: int) -> DataFrame:
    """query_id, vec_id, score: what the queries find in the shards that they were sent to, and had not found before."""
    asked = materialize(asked)
    blocks = asked.groupBy("shard", "part").count().select("shard", "part", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    small = F.broadcast(blocks)  # a row for each shard at most
    asked = asked.join(small, ["shard", "part"]).select("shard", "part", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tree"), "query_id", "v", "ids", "scores")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("query_id", "long"), ("v", "array<double>"), ("ids", "array<long>"), ("scores", "array<long>"))]
    there = trees.join(small, ["shard", "part"]).select("shard", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "tree", *nothing)
    key = ["shard", "part", "block"]
    rows = there.union(asked).repartition(*key).sortWithinPartitions(*key, "kind")  # a shard's tree comes before its queries
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        tree = None
        for b in batches:
            out: list[tuple] = []
            for packed, query, v, ids, scores in zip(*(b.column(n).to_pylist() for n in (0, 1, 2, 3, 4))):
                if packed is not None:
                    tree = pickle.loads(packed)
                    continue
                here, own = tree.among(np.floor(scale * np.array(v, np.float64)))
                before = [(s, -i) for s, i in zip(scores, ids)]
                best = here.search(own, query, k, before)
                results(query, [x for x in best if x not in before], out)
            yield batch(schema, query_id=[x[0] for x in out], vec_id=[x[1] for x in out], score=[x[2] for x in out])

    return map_batches(rows.select("tree", "query_id", "v", "ids", "scores"), run, "query_id long, vec_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, best: the k best results of each query; k from each shard that it visited at most meet here."""
    return found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("vec_id")).alias("behind"))), asc=False), 1, k).alias("best"))


@scratch
def neighbours(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = dealt(whole(vectors), shard_rows)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        numbers = np.floor(scale * np.array(part.v.tolist(), np.float64))
        tree = Tree(part.vec_id.to_numpy(), numbers)
        return pd.DataFrame([(int(part.shard.iloc[0]), int(part.part.iloc[0]), tree.low[0].tolist(), tree.high[0].tolist(), pickle.dumps(tree))], columns=["shard", "part", "low", "high", "tree"])

    trees = materialize(rows.groupBy("shard", "part").applyInPandas(build, "shard int, part int, low array<double>, high array<double>, tree binary"))
    by_size: dict[int, list] = {}
    for r in sorted(trees.select("shard", "part", "low", "high").collect()):  # at most about BOXES bytes
        by_size.setdefault(len(r["low"]), []).append(r)
    boxes = spark.sparkContext.broadcast({n: (np.array([r["shard"] for r in x]), np.array([r["part"] for r in x]), np.array([r["low"] for r in x]), np.array([r["high"] for r in x])) for n, x in by_size.items()})
    none = F.array().cast("array<long>")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", none.alias("ids"), none.alias("scores"))
    near = materialize(best_of(visited(sent(queries, boxes, scale, k, True), trees, scale, k), k))
    ids, scores = F.transform("best", lambda x: -x["behind"]), F.transform("best", lambda x: x["score"])
    carried = queries.select("query_id", "v").join(near, "query_id", "left").select("query_id", "v", F.coalesce(ids, none).alias("ids"), F.coalesce(scores, none).alias("scores"))
    more = visited(sent(carried, boxes, scale, k, False), trees, scale, k)
    flat = near.select("query_id", F.explode("best").alias("x")).selectExpr("query_id", "-x.behind vec_id", "x.score score")
    out = best_of(flat.union(more), k)
    return out.select("query_id", F.posexplode("best").alias("pos", "x")).selectExpr("query_id", "cast(pos + 1 as int) rank", "-x.behind vec_id", "x.score score")
