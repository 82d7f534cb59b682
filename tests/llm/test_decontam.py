"""Benchmark windows against a plain scan."""

import hashlib
import random
import re
import tracemalloc

import pytest

from relloom.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for g, owners in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= owners
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.fixture
def planted():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)] + ["Été", "ÉTÉ", "x1"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 13, 14, 30])))) for k in range(12)] + [(12, None), (None, "w1 w2"), (13, "... !"), (14, "w1 w2 w3")]
    rows = []
    for i in range(80):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if i % 3 == 0:
            item = (rng.choice(items[:12])[1]).split()
            at = rng.randint(0, len(text))
            cut = rng.randint(0, 3)
            text[at:at] = [x.upper() if rng.random() < 0.2 else x + rng.choice(["", ",", "-"]) for x in item[cut:]]
        rows.append((i, " ".join(text)))
    return rows, items


def run(spark, df, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination(df, bench).collect())


def test_planted_windows(spark, docs, planted, odd):
    rows, items = planted
    assert run(spark, docs(rows), items) == brute(rows, items)
    assert run(spark, docs(odd), items) == brute(odd, items)
    assert run(spark, docs(odd), []) == brute(odd, [])
    assert run(spark, docs(odd).limit(0), items) == []


def test_many_blocks_give_the_same(spark, docs, planted, monkeypatch):
    rows, items = planted
    real = decontam.blocks
    monkeypatch.setattr(decontam, "blocks", lambda b: real(b, 100))
    assert len(decontam.blocks(spark.createDataFrame(items, "item_id long, text string"))) > 3
    assert run(spark, docs(rows), items) == brute(rows, items)


def test_windows_under_one_hash_are_told_apart(planted, monkeypatch):
    monkeypatch.setattr(decontam, "FACTOR", 1)  # a window's hash is the sum of its ids: many collide
    rows, items = planted
    items = items + [(20, "w1 " * 40), (21, "w1 " * 13), (22, "w2 w1 " + "w1 w2 " * 20)]
    windows = decontam.Windows([(i, t) for i, t in items if i is not None and t is not None])
    rows = rows + [(500, "w1 " * 30), (501, "w2 w1 " * 9)]
    for (i, t), want in zip(rows, [r for row in rows for r in brute([row], items)]):
        mask, found = windows.scan(decontam.words_of(t))
        assert (0 if mask is None else int(mask.sum()), len(found)) == want[2:4], i


def test_memory_and_time_of_a_block():
    """A full block takes less than 300 MB in a worker, and is built once a process."""
    rng = random.Random(2)
    vocabulary = [f"word{k}" for k in range(200_000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=200))) for k in range(8_000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    windows = decontam.Windows(items)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size > decontam.BLOCK_BYTES * 0.9 and most < 300e6
    mask, found = windows.scan(decontam.words_of("x " + items[77][1][50:400] + " y"))
    assert found == {"77"} and 0 < mask.sum() < len(mask)


def test_very_long_texts_and_empty_tables(spark, docs, planted):
    rows, items = planted
    long = " ".join(["w39 w38"] * 150_000) + " " + items[0][1] + " " + "zz " * 1000
    assert run(spark, docs([(1, long), (2, None)]), items) == sorted(brute([(1, long)], items) + brute([(2, None)], items))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.remove(docs(rows).limit(0), bench).count() == 0 and decontam.remove(docs(rows), bench.limit(0)).count() == len(rows)


def test_remove_documents_or_spans(spark, docs, planted):
    rows, items = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {int(r[0]) for r in brute(rows, items) if r[5]}
    kept = decontam.remove(docs(rows), bench)
    assert kept.columns == docs(rows).columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - bad
    clean = decontam.remove(docs(rows), bench, mode="spans")
    hit = {int(r[0]): r[2] for r in brute(rows, items)}
    for r in clean.collect():
        assert len(words(r["text"])) == len(words(dict(rows)[r["doc_id"]])) - hit[r["doc_id"]]
