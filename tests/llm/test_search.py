"""Exact top-k search against brute force."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from relloom.llm import kdtree


def brute(rows, every, k=5, scale=256):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (i not in ok or list(v) < list(ok[i])):
            ok[i] = v
    ints = {i: [math.floor(scale * float(np.float32(x))) for x in v] for i, v in ok.items()}
    out = []
    for q in ints:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, every, shard_rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    return sorted(map(tuple, kdtree.neighbours(df, every=every, shard_rows=shard_rows).collect()))


def test_random_vectors_over_many_shards(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)]
    assert run(spark, rows, 20, 64) == brute(rows, 20)


def test_ties_copies_and_bad_vectors(spark):
    rows = [(i, [0.5, 0.25]) for i in range(40)] + [(40, None), (41, [None, 1.0]), (42, [float("nan"), 1.0]), (43, [float("inf"), 0.0]), (None, [1.0, 1.0]), (44, []), (10, [0.5, 0.25]), (50, [1.0, 2.0, 3.0])]
    assert run(spark, rows, 10, 16) == brute(rows, 10)


def test_copies_of_one_vector_are_dealt_to_many_shards(spark):
    rows = [(i, [1.0, 2.0]) for i in range(150)] + [(1000 + i, [float(i % 7), float(i % 5)]) for i in range(150)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    parts = kdtree.dealt(kdtree.whole(df), 16).groupBy("shard", "part").count().collect()
    assert max(r["count"] for r in parts) < 40 and len(parts) > 10
    assert run(spark, rows, 10, 16) == brute(rows, 10)


def test_queries_go_only_where_they_may_find_something(spark, monkeypatch):
    """Distant clusters: after its nearest shards a query visits few others, and their number doesn't grow with the clusters."""
    rng = np.random.default_rng(1)
    made = []
    real = kdtree.visited
    monkeypatch.setattr(kdtree, "visited", lambda asked, *more: made.append(asked.count()) or real(asked, *more))
    rows = []
    for c in range(16):
        centre = 20 * np.array([np.cos(c * np.pi / 8), np.sin(c * np.pi / 8)])
        rows += [(c * 64 + j, (centre + rng.normal(size=2)).round(2).tolist()) for j in range(64)]
    assert run(spark, rows, 16, 64) == brute(rows, 16)
    assert made[0] == 2 * 64 and made[1] < 4 * 64  # 64 queries, 16 shards or more


def test_many_queries_of_a_shard_are_taken_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "BLOCK", 7)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).round(1).tolist()) for i in range(200)]
    assert run(spark, rows, 2, 64) == brute(rows, 2)


def test_few_candidates_and_empty_table(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert run(spark, rows, 1, 4) == brute(rows, 1)
    assert run(spark, [], 1, 4) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=80), st.integers(1, 6))
def test_tree_search_is_exact(vectors, k):
    kdtree.LEAF, before = 4, kdtree.LEAF
    try:
        ids = np.arange(len(vectors))[::-1].copy()
        rows = np.array(vectors, float)
        tree = kdtree.Tree(ids, rows)
        for i, q in zip(ids, rows):
            want = sorted(((float(r @ q), -int(j)) for j, r in zip(ids, rows) if j != i), reverse=True)[:k]
            assert tree.search(q, int(i), k, []) == want
    finally:
        kdtree.LEAF = before


def test_huge_components_stay_exact(spark):
    rows = [(0, [3e7, -3e7]), (1, [3e7, 3e7]), (2, [1.0, -1.0])]
    assert run(spark, rows, 1, 8) == brute(rows, 1)


def test_k_is_kept(spark):
    rows = [(i, [float(i)]) for i in range(20)]
    assert max(r[1] for r in run(spark, rows, 5, 8)) == 5
