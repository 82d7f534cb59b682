"""The pipeline: stages in order, each on what the one before kept."""

import random

import pytest

import __spark_entry__ as entry

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def tables(spark, docs, labels, tmp_path):
    rng = random.Random(8)
    good = lambda n: " ".join("".join(rng.choice(["ta", "ren", "mo", "li", "sha"]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, good(rng.randint(20, 60))) for i in range(200)]
    known = [(i, 1, 0) for i in range(200)]
    rows += [(200 + i, good(30).upper().replace(" ", "!! ")) for i in range(80)]
    known += [(200 + i, 0, 0) for i in range(80)]
    item = good(40)
    rows += [(300, rows[3][1]), (301, item), (302, None), (303, "123 456"), (304, rows[5][1] + " end")]
    lang = {i: "aa" for i in range(280)}
    docs(rows, lang).write.parquet(f"{tmp_path}/documents.parquet")
    labels(known).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "encoding":
            assert out.columns == docs.columns
        docs = corpus_pipeline.materialize(out)
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {302, 303}.isdisjoint(seen["language"]) and len(seen["language"]) == 283
    gone = seen["language"] - seen["quality"]
    assert len(gone & set(range(200, 280))) >= 78 and len(gone & set(range(200))) <= 2
    assert {300, 304}.isdisjoint(seen["near_duplicates"]) and seen["near_duplicates"] | {300, 304} == seen["quality"]
    assert seen["decontamination"] == seen["near_duplicates"] - {301} == seen["encoding"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, tables).collect()} == seen["encoding"]


def test_near_duplicates_of_80_percent_go(spark, docs):
    words = [f"w{k}" for k in range(100)]
    near = list(words)
    near[20] = near[70] = "other"  # 0.811
    kept = corpus_pipeline.distinct(spark, docs([(1, " ".join(words)), (2, " ".join(near))]), "")
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_registered():
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")} == set(range(1, 11))
