"""The store's versions, tiers and recovery."""

import random
import uuid

import pytest

from relloom.llm import sharding


@pytest.fixture
def store(spark, tmp_path):
    return sharding.Store(spark, f"file://{tmp_path}/store", target=40_000, base=2_000, fan=3)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_append_compact_and_old_versions(spark, docs, store):
    table = docs([(i, f"text {i} " * (i % 50)) for i in range(200)])
    for k in range(4):
        store.append(table.where(f"doc_id % 4 = {k}"))
    before = store.manifest()
    after = store.compact()
    assert after["version"] > before["version"] == 4 and len(after["files"]) < len(before["files"])
    assert ids(store.read()) == list(range(200)) and store.read().columns == table.columns
    assert ids(store.read(1)) == [i for i in range(200) if i % 4 == 0]  # files of old versions stay until vacuum
    assert not store.due(after["files"])
    assert store.vacuum() == 0  # too young: it could be another writer's
    assert store.vacuum(keep=100, age=0) == 0 and ids(store.read(1)) == [i for i in range(200) if i % 4 == 0]
    assert store.vacuum(keep=1, age=0) > 0 and ids(store.read()) == list(range(200))


def test_two_writers_cannot_take_one_version(spark, docs, store):
    store.append(docs([(1, "a")]))
    now = store.manifest()
    store.append(docs([(2, "b")]))
    with pytest.raises(Exception, match="exist"):
        store.commit(now, now["files"], now["schema"])
    assert ids(store.read()) == [1, 2]


def test_orphans_are_not_seen(spark, docs, store):
    store.append(docs([(1, "a")]))
    store.written(docs([(2, "b")]))  # a writer that died before its commit
    assert ids(store.read()) == [1]
    assert store.vacuum(age=0) == 1


def test_vacuum_beside_a_writer(spark, docs, store):
    """Files that are written but not yet committed outlive a vacuum, and the commit is sound."""
    store.append(docs([(1, "a")]))
    files = store.written(docs([(2, "b")]))
    assert store.vacuum() == 0
    store.changed(lambda now: now + files)
    assert ids(store.read()) == [1, 2]


def test_a_lost_commit_is_put_on_top_of_the_winner(spark, docs, store, monkeypatch):
    store.append(docs([(1, "a")]))
    real, once = store.commit, []

    def commit(before, files, schema):
        if not once:  # another writer takes this version first
            once.append(1)
            real(before, before["files"] + store.written(docs([(3, "c")])), schema)
        return real(before, files, schema)

    monkeypatch.setattr(store, "commit", commit)
    store.append(docs([(2, "b")]))
    assert ids(store.read()) == [1, 2, 3] and store.manifest()["version"] == 3


def test_tiers_against_a_plain_model(store):
    """Compaction on sizes alone, by the definition: merge the lowest tier with ``fan`` files until there is none."""
    rng, held = random.Random(4), []
    file = lambda size: {"path": uuid.uuid4().hex, "bytes": size}
    for _ in range(300):
        held.append(file(rng.randint(1, 9_000)))
        while True:
            tiers = {}
            for f in held:
                if f["bytes"] < 20_000:
                    t, size = 0, 2_000
                    while f["bytes"] >= size:
                        t, size = t + 1, size * 3
                    tiers.setdefault(t, []).append(f)
            want = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= 3), [])
            assert store.due(held) == want
            if not want:
                break
            total = sum(f["bytes"] for f in want)
            held = [f for f in held if f not in want] + [file(total // max(1, round(total / 40_000))) for _ in range(max(1, round(total / 40_000)))]
        assert sum(f["bytes"] < 20_000 for f in held) <= 2 * 4  # so few small files are left, however many arrivals there were


def test_tiers_merge_likes_only(store):
    file = lambda size: {"path": str(size), "bytes": size}
    assert store.tier(0) == 0 and store.tier(2_000) == 1 and store.tier(6_000) == 2
    assert store.due([file(s) for s in (100, 200, 2_500, 7_000, 30_000, 30_001, 30_002)]) == []
    assert len(store.due([file(s) for s in (100, 200, 300, 2_500)])) == 3


def test_query_keeps_every_row(spark, docs, odd):
    rows = sharding.sharded(docs(odd)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in odd)
    assert sharding.sharded(docs(odd).limit(0)).count() == 0
