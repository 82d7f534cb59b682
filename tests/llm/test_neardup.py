"""Near-duplicates against brute force on full sets."""

import pathlib
import random
import re

import numpy as np
import pytest

from relloom.llm import common, neardup


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def run(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.components(df).collect() if r["doc_id"] is not None}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_families_of_copies(spark, docs):
    rng = random.Random(4)
    texts = []
    for f in range(4):
        base = [f"f{f}w{rng.randrange(60)}" for _ in range(rng.choice([12, 80, 150]))]
        texts += family(rng, base, 25, 3)
    texts += ["Just ONE line"] * 5 + ["just one line"] * 3 + ["a", "A", "b c"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(docs(rows)) == brute(rows)


@pytest.mark.parametrize("wide", [64, 0])
def test_blocks_finish_what_neighbours_miss(spark, docs, monkeypatch, wide):
    """Near the threshold many pairs of a bucket are no links, so components meet only through certain members."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "WIDE", wide)
    monkeypatch.setattr(neardup, "RARE", 2)
    monkeypatch.setattr(neardup, "SIDE_BY_SIDE", 1)  # buckets of two are left to the blocks as well
    monkeypatch.setattr(neardup, "joined_up", lambda pairs, sets, roots, rounds: None)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(130)]
    rows = list(enumerate(family(rng, base, 60, 6)))
    assert run(docs(rows)) == brute(rows)


def test_rare_shingles_of_one_template_are_their_own(spark):
    """Sets that share 70 of 100 shingles never meet; sets that share 95 do, and the number taken is what the threshold needs."""
    page = lambda k: np.array([*range(70), *range(1000 * k, 1000 * k + 30)], np.uint64)
    sets = {k: page(k) for k in range(1, 90)}
    sets[90] = np.append(sets[5][:95], np.arange(5, dtype=np.uint64) + np.uint64(999_000))
    frame = spark.createDataFrame([(k, v.tobytes()) for k, v in [*sets.items(), (91, np.zeros(0, np.uint64))]], "rep long, hashes binary")
    held = {}
    for r in neardup.rare_shingles(frame, 85).collect():
        held.setdefault(r["hash"], []).append(r["rep"])
    assert {tuple(sorted(v)) for v in held.values() if len(v) > 1} == {(5, 90)}
    assert sum(len(v) for v in held.values()) == 90 * 16


def test_odd_rows(spark, docs, odd):
    got = run(docs(odd))
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True) and got[8] == (2, 8, True)
    none = [r for r in neardup.components(docs(odd)).collect() if r["doc_id"] is None]
    assert len(none) == 1 and none[0]["component_id"] is None and none[0]["kept"] is False
    assert neardup.components(docs(odd).limit(0)).count() == 0


def test_keep_leaves_one_whole_row_of_each(spark, docs, odd):
    kept = neardup.keep(docs(odd))
    assert kept.columns == docs(odd).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 4, 5, None, 6, 7, 8]))


def test_bands_follow_from_the_threshold():
    assert neardup.banding() == neardup.banding(85) == (6, 24) and neardup.banding(80) == (5, 28)
    rows = np.arange(288, dtype=np.uint16).reshape(2, 144)
    assert neardup.band_keys(rows).shape == (2, 24) and neardup.band_keys(rows, 80).shape == (2, 28)
    assert all(x <= y for x, y in zip(neardup.least_matches(80), neardup.least_matches(85)))


def test_threshold_is_an_argument(spark, docs):
    words = [f"w{k}" for k in range(100)]
    near = list(words)
    near[20] = near[70] = "other"  # 86 shingles of 106 are shared: 0.811
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(f"v{k}" for k in range(100)))]
    at = lambda percent: {r["doc_id"]: r["component_id"] for r in neardup.components(docs(rows), percent).collect()}
    assert at(85) == {1: 1, 2: 2, 3: 3} and at(80) == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"] for r in neardup.keep(docs(rows), 80).collect()} == {1, 3}


def test_block_links_by_hand(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LOOKED_UP", 4)
    members = {1: range(10), 2: range(1, 10), 3: range(20, 30), 4: range(11), 5: []}
    blocks = spark.createDataFrame([(0, 0, 0, k, k, k == 1) for k in members], "key long, i int, j int, rep long, comp long, probe boolean")
    sets = spark.createDataFrame([(k, np.array(list(v), np.uint64).tobytes()) for k, v in members.items()], "rep long, hashes binary")
    assert sorted(map(tuple, neardup.block_links(blocks, sets, 85).collect())) == [(1, 2), (1, 4)]
def test_keep_tells_rows_of_one_id_apart(spark, docs):
    one, two = (" ".join(f"{a}{k}" for k in range(40)) for a in "vw")
    rows = [(1, one), (5, one), (5, two), (9, two), (7, "alone in here"), (8, "twice"), (8, "twice")]
    kept = neardup.keep(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, one), (5, two), (7, "alone in here"), (8, "twice")])


def test_unrelated_texts_of_one_id_both_stay(spark, docs):
    one, two = (" ".join(f"{a}{k}" for k in range(40)) for a in "vw")
    kept = neardup.keep(docs([(5, one), (5, two), (5, two.upper()), (5, one)])).collect()
    assert sorted(r["text"].lower() for r in kept) == [one, two]


def test_scratch_tables_go(spark, docs, monkeypatch):
    """After a run only tables that its result still reads are left."""
    made = []
    monkeypatch.setattr(neardup, "materialize", lambda df: made.append(df) or common.materialize(df))
    text = " ".join(f"w{k}" for k in range(60))
    out = neardup.components(docs([(1, text), (2, text + " more"), (3, "other words are in this one")]))
    read = {f.rpartition("/")[0] for f in out.inputFiles()}
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert before == {1: 1, 2: 1, 3: 3} and len(made) > 8
    left = {p.name for p in pathlib.Path(root).iterdir()} & {f.rpartition("/")[2] for f in read}
    assert len(left) == len(read) <= 4


def test_components_of_long_chains(spark):
    n = 200
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:])]
    roots = neardup.contracted(spark.createDataFrame(edges, "ca long, cb long"))
    assert {r["root"] for r in roots.collect()} == {0} and roots.count() == n - 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    same = (neardup.signature(a) == neardup.signature(b)).mean()
    assert abs(same - 900 / 1100) < 0.12


def test_miss_probability_bounds():
    least = neardup.least_matches()
    assert all(b >= a for a, b in zip(least, least[1:])) and least[144] < 0.85 * 144
    left = np.zeros((2, 144), np.uint16)
    right = left.copy()
    right[1, :100] = 1
    assert neardup.plausible(left, right, least).tolist() == [True, False]
