"""Operators against small literals and plain Python."""

import json
import pathlib
import random
import uuid

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relloom.operators import assemble, calibrate, evaluation, pairs, prediction, profile, retrieval, runner, sampling, search, votes
from relloom.sources import config, jsonl
from relloom.streaming import incremental

MODELS = [f"m{i}" for i in range(5)]


def annotations(spark, rows):
    return spark.createDataFrame([(q, m, label, o, 0.5) for o, (q, m, label) in enumerate(rows)], "doc_id string, model_name string, annotated_label string, ord long, score double")


def test_votes_keep_drop_and_overwrite(spark):
    rows = [("a", f"m{i}", x) for i, x in enumerate(["yes", "yes", "yes", None, None])]
    rows += [("b", f"m{i}", x) for i, x in enumerate(["yes", "yes", "no", "no", None])]
    rows += [("c", "m0", "yes"), ("c", "m0", None)]
    df = annotations(spark, rows)
    kept = votes.merged(df, ["doc_id"], MODELS).collect()
    assert [(r["doc_id"], r["annotated_label"]) for r in kept] == [("a", "yes")]
    wide = {r["doc_id"]: r for r in votes.wide(df, ["doc_id"], MODELS).collect()}
    assert wide["c"]["m0_annotated_label"] is None  # the later null overwrites
    counts = {r["doc_id"]: r for r in votes.counts(df, ["doc_id"]).collect()}
    assert counts["c"]["yes_votes"] == 1  # but the first label has been counted
    todo = df.select("doc_id").distinct()
    assert {r["doc_id"] for r in votes.pending(todo, df, ["doc_id"], "m4").collect()} == {"b", "c"}


def test_bucket_edge_follows_the_number(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0.15, 0.3, 0.31, 0.7])], "id long, s double")
    got = {r["id"]: r["bucket"] for r in sampling.balanced_buckets(df, "s", "id").collect()}
    assert got[0] == 2  # 0.15 / 0.05 is just below 3


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(0, 12))
def test_first_of_groups_is_the_hash_order(spark, groups, cap):
    import hashlib

    df = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "id long, g long")
    got = sorted(r["id"] for r in sampling.first_of_groups(df, ["g"], "id", "t", cap).collect())
    want = []
    for g in set(groups):
        ids = sorted((i for i, x in enumerate(groups) if x == g), key=lambda i: (hashlib.md5(f"t|{i}".encode()).hexdigest(), i))
        want += ids[:cap]
    assert got == sorted(want)


def test_ratio_shrinks_one_side(spark):
    df = spark.createDataFrame([(i, "a" if i < 40 else "b") for i in range(100)], "id long, k string")
    n = {r["k"]: r["count"] for r in sampling.at_ratio(df, "k", "a", "b", "id").groupBy("k").count().collect()}
    assert n == {"a": 40, "b": 60}
    few = df.where("id < 60")
    n = {r["k"]: r["count"] for r in sampling.at_ratio(few, "k", "a", "b", "id").groupBy("k").count().collect()}
    assert n == {"a": 13, "b": 20}


def test_interleave_covers_both(spark):
    rows = sampling.interleaved(spark, 20, 5, 0.3).collect()
    assert len(rows) == max(-(-20 // 0.7), -(-5 // 0.3))
    for use, size in ((True, 5), (False, 20)):
        local = [r["local"] for r in sorted(rows, key=lambda r: r["pos"]) if r["use_sft"] == use]
        assert local == [i % size for i in range(len(local))]
    with pytest.raises(ValueError):
        sampling.interleaved(spark, 0, 0, 0.3)


def test_top_k_against_plain_python(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<float>")
    got = {}
    for r in retrieval.top_k(df.where("vec_id < 5").withColumnRenamed("vec_id", "query_id"), df, 3, shard=16, block=2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    f32 = dict(df.collect())
    for q in range(5):
        order = sorted((i for i in f32 if i != q), key=lambda i: (-sum(a * b for a, b in zip(f32[q], f32[i])), i))[:3]
        assert [got[q][k] for k in (1, 2, 3)] == order


def test_negatives_in_both_orders(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, vec_id long, rank int")
    positives = spark.createDataFrame([(1, 10)], "query_id long, vec_id long")
    assert [r["vec_id"] for r in retrieval.negatives(found, positives, 2).collect()] == [11]
    assert sorted(r["vec_id"] for r in retrieval.negatives_after(found, positives, 2).collect()) == [11, 12]


def test_evaluate_resumes_and_drops_blanks(spark):
    df = spark.createDataFrame([(0, "q", ["a", " ", "b"], [0.0, 1.0, 1.0]), (1, "q", ["a"], [1.0])], "idx int, query string, documents array<string>, relevance array<double>")
    done = spark.createDataFrame([(1,)], "idx int")
    scorer = lambda q, d: F.transform(d, lambda x, i: -i.cast("double"))
    rows = evaluation.evaluate(df, done, scorer).collect()
    assert [(r["idx"], len(r["scores"])) for r in rows] == [(0, 2)] and rows[0]["ndcg"] == pytest.approx(0.6309298)


def test_gate_is_strict_below_only(spark):
    cols = lambda p, n: ([F.array(*map(F.lit, p))] * 2, [F.array(*map(F.lit, n))] * 2)
    keep = lambda p, n: spark.range(1).select(pairs.teacher_gate(*cols(p, n))).first()[0]
    assert keep([0.9], [0.9] * 7) and not keep([0.9], [0.9] * 6) and not keep([0.4], [0.1] * 7) and not keep([0.8], [0.9] * 7)


def test_split_instruction(spark):
    df = spark.createDataFrame([(" do\n Query:  cats ", [" a ", " "], ["n"]), ("cats", ["a"], ["n"]), ("x\n Query: y z", [" "], ["n"])], "q string, p array<string>, n array<string>")
    assert [tuple(r) for r in pairs.split_instruction(df, "q", "p", "n").collect()] == [("cats", ["a"], ["n"])]


def test_percentiles(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "v int")
    assert profile.nearest_percentiles(df, [], "v", [50]).first()["value"] == 3
    assert profile.linear_percentiles(df, [], "v", [50]).first()["value"] == 2.5


def test_percentiles_of_many_values(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None]), rng.choice([None, 0.5, rng.random(), float(rng.randint(0, 9))])) for _ in range(6000)]
    df = spark.createDataFrame([*rows, ("one", 7.0), ("none", None)], "g string, v double")
    near = {(r["g"], r["p"]): r["value"] for r in profile.nearest_percentiles(df, ["g"], "v", [0, 37, 50, 99, 100]).collect()}
    between = {(r["g"], r["p"]): r["value"] for r in profile.linear_percentiles(df, ["g"], "v", [0, 37, 50, 99, 100]).collect()}
    for g in ("a", None, "one"):
        values = sorted(v for h, v in [*rows, ("one", 7.0)] if h == g and v is not None)
        for p in (0, 37, 50, 99, 100):
            assert near[g, p] == values[min(len(values) * p // 100, len(values) - 1)]
            assert between[g, p] == pytest.approx(float(np.percentile(values, p)))
    assert len(near) == len(between) == 15
    rest = {r["g"]: (r["n"], r["median"]) for r in profile.summary(df, ["g"], "v").collect()}
    assert rest["none"] == (0, None) and rest["one"] == (1, 7.0) and len(rest) == 4


def test_trailing_over_the_ends_of_spans(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["u", "u", "w"]), 3600 * 40 + rng.randint(-200, 4000), 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["n_trailing"] for r in incremental.trailing(df, 60).collect()}
    assert got == {i: sum(u == v and s - 60 <= t <= s for _, v, t, _ in rows) for i, u, s, _ in rows}


def test_top_k_with_ties_and_small_parts(spark):
    rows = [(i, None if i == 7 else [float(i % 3), 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    got = retrieval.top_k(df.where("vec_id in (2, 7)").withColumnRenamed("vec_id", "query_id"), df, 4, shard=8, block=1).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 5), (2, 8), (2, 11), (2, 14)]
    assert not retrieval.top_k(df.limit(0).withColumnRenamed("vec_id", "query_id"), df, 4).collect()


def test_ingest_keeps_repeated_batches_once_and_null_keys(spark, tmp_path):
    source, sink, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    for rows in ([(1, "a"), (None, "n")], [(None, "m"), (1, "b"), (2, "c")]):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").json(source)
        incremental.ingest(spark, source, "k long, v string", sink, mark, ["k"]).awaitTermination()
    assert sorted((r["k"] or 0, r["v"]) for r in spark.read.parquet(sink).collect()) == [(0, "n"), (1, "a"), (2, "c")]


def test_sweep_matches_plain_counts(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0.1, 0.25, 0.5, rng.random()]), rng.random() < 0.4) for _ in range(80)]
    got = {r["level"]: r for r in calibrate.sweep(spark.createDataFrame(rows, "score double, positive boolean"), 20).collect()}
    for level in range(21):
        tp = sum(p and s * 20 >= level for s, p in rows)
        fp = sum(not p and s * 20 >= level for s, p in rows)
        assert got[level]["precision_above"] == pytest.approx(tp / (tp + fp) if tp + fp else 0)


def test_sweep_meets_its_thresholds_exactly(spark):
    rows = [(0.29, True), (0.57, True), (0.07, False), (0.5, False)]
    got = {r["level"]: r for r in calibrate.sweep(spark.createDataFrame(rows, "score double, positive boolean")).collect()}
    assert (got[29]["precision_above"], got[29]["recall_above"], got[29]["hits_above"]) == (pytest.approx(2 / 3), 1.0, 3)
    assert (got[57]["precision_above"], got[57]["recall_above"]) == (1.0, 0.5) and got[7]["recall_below"] == 0.5
    for level in range(101):
        t = level / 100
        assert got[level]["hits_above"] == sum(s >= t for s, _ in rows) and got[level]["hits_below"] == sum(s <= t for s, _ in rows)


def test_calibration_of_one_class_or_nothing(spark):
    empty = spark.createDataFrame([], "q string, score double, positive boolean")
    assert calibrate.calibrated(empty, "q", [0.9], [0.1], points=50).count() == 0
    one = spark.createDataFrame([(str(i), i / 10, True) for i in range(10)], "q string, score double, positive boolean")
    assert calibrate.calibrated(one, "q", [0.9], [0.1], points=50).count() == 0


def test_null_is_a_group_like_others(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else None) for i in range(15)], "id long, g string")
    got = sampling.first_of_groups(df, ["g"], "id", "t", 3).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"a": 3, None: 3}


def test_positions_by_length(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, "x" * rng.randint(0, 5)) for i in range(100)], "id long, t string")
    got = sorted(sampling.length_batches(df, F.length("t"), "id", 8).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(100)) and [r["batch"] for r in got] == [k // 8 for k in range(100)]
    assert [len(r["t"]) for r in got] == sorted(len(r["t"]) for r in got)


def test_prediction_routes(spark):
    scores = "<scores>" + "".join(f"<{f}>3</{f}>" for f in ("contribution_accuracy", "contribution_coverage", "evidence_faithfulness", "evidence_self_contained", "evidence_concision", "overall")) + "</scores>"
    full = "yes <contribution>c</contribution><evidence>e</evidence>"
    df = spark.createDataFrame([(0, full, "yes", scores), (1, "yes", "yes", scores), (2, full, "no", scores), (3, full, "yes", "")], "id int, pred_text string, annotated_label string, judge_text string")
    got = {r["id"]: r["eval_status"] for r in prediction.routed(prediction.enriched(df)).collect()}
    assert got == {0: "scored", 1: "skipped_no_parse", 2: "skipped_not_yesyes", 3: "failed"}


def test_runner_retries_nulls_and_resumes(spark):
    df = spark.createDataFrame([("a", "p1"), ("b", "p2")], "k string, prompt string")
    done = spark.createDataFrame([("a", "x"), ("b", None)], "k string, answer string")
    rows = runner.resumed(df, done, "k", "prompt", "answer", lambda ps: [p.upper() for p in ps]).collect()
    assert [tuple(r) for r in rows] == [("b", "p2", "P2")]


class Counting:
    """A client that writes down what it is asked, in a folder, and answers otherwise each time."""

    def __init__(self, folder, answer):
        self.folder, self.answer = str(folder), answer

    def __call__(self, prompts):
        name = f"{self.folder}/{uuid.uuid4().hex}"
        with open(name, "w") as out:
            out.writelines(f"{p}\n" for p in prompts)
        return [self.answer(p) for p in prompts]

    def asked(self):
        return [x for p in pathlib.Path(self.folder).iterdir() for x in p.read_text().split("\n") if x]


def test_repair_asks_each_row_once_a_round(spark, tmp_path):
    folders = [tmp_path / str(k) for k in range(3)]
    for f in folders:
        f.mkdir()
    clients = [Counting(f, lambda p: f"bad {uuid.uuid4().hex}" if int(p) % 2 else "good") for f in folders]
    df = spark.createDataFrame([(str(i), "bad") for i in range(10)], "prompt string, answer string")
    out = runner.repaired(df, "prompt", "answer", F.col("answer").startswith("bad"), clients)
    first, second = sorted(map(tuple, out.collect())), sorted(map(tuple, out.collect()))
    assert first == second and len(first) == 10 and sum(a == "good" for _, a in first) == 5
    assert sorted(clients[0].asked()) == [str(i) for i in range(10)]
    assert sorted(clients[1].asked()) == sorted(clients[2].asked()) == ["1", "3", "5", "7", "9"]


def broken(prompts):
    raise OSError("no network")


def test_an_outage_is_no_empty_answer(spark):
    df = spark.createDataFrame([("a", "p")], "k string, prompt string")
    with pytest.raises(Exception, match="no network"):
        runner.called(df, "prompt", "answer", broken).collect()
    row = runner.called(df, "prompt", "answer", broken, error="why").first()
    assert row["answer"] is None and "no network" in row["why"]
    assert runner.translated(df, "prompt", broken).first()["prompt"] == "p"


def test_runs_resume(spark, tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()
    client = Counting(folder, lambda p: None if p == "p3" and len(list(folder.iterdir())) < 9 else p.upper())
    df = spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(4)] + [("k0", "p0"), (None, "p9")], "k string, prompt string")
    store = f"file://{tmp_path}/store"
    out = runner.run_resumed(spark, df, store, "k", "prompt", "answer", client, retries=0)
    assert {r["k"]: r["answer"] for r in out.collect()} == {"k0": "P0", "k1": "P1", "k2": "P2", "k3": None, None: None} and out.count() == 6
    before = len(client.asked())
    assert before == 4
    runner.run_in_rounds(spark, df, store, "k", "prompt", "answer", client, 3, retries=0)
    assert client.asked().count("p3") == 2 and len(client.asked()) == 5  # only what had no answer is asked again


def test_annotation_run_stops_early(spark, tmp_path):
    folders = [tmp_path / f"m{k}" for k in range(5)]
    for f in folders:
        f.mkdir()
    says = lambda k: lambda p: "yes." if p == "sure" or k % 2 else "No, because"
    models = {f"m{k}": Counting(f, says(k)) for k, f in enumerate(folders)}
    df = spark.createDataFrame([("a", "sure"), ("b", "split")], "k string, prompt string")
    out = {r["k"]: r for r in runner.voted(spark, df, f"file://{tmp_path}/stores", "k", "prompt", models).collect()}
    assert (out["a"]["yes_votes"], out["a"]["annotated_label"]) == (3, "yes") and (out["b"]["no_votes"], out["b"]["annotated_label"]) == (3, "no")
    assert [sorted(m.asked()) for m in models.values()] == [["split", "sure"]] * 3 + [["split"]] * 2


def test_flag_filter_run(spark, tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()
    client = Counting(folder, lambda p: "Yes" if "ill" in p else "no")
    df = spark.createDataFrame([("ill",), ("ill",), ("well",), (None,)], "t string")
    kept = runner.flagged_out(spark, df, f"file://{tmp_path}/flags", "t", client)
    assert sorted(str(r["t"]) for r in kept.collect()) == ["None", "well"] and sorted(client.asked()) == ["ill", "well"]


def test_evaluation_over_datasets_uses_its_cache(spark, tmp_path):
    for name, grades in (("a", [0.0, 1.0]), ("b", [1.0, 0.0])):
        spark.createDataFrame([(i, "q", ["x", "y"], grades) for i in range(3)], "idx int, query string, documents array<string>, relevance array<double>").coalesce(1).write.json(f"{tmp_path}/in/{name}.jsonl")
    read = lambda path: spark.read.schema("idx int, query string, documents array<string>, relevance array<double>").json(path)
    scorer = lambda q, d: F.transform(d, lambda x, i: -i.cast("double"))
    for _ in range(2):
        out = {r["dataset"]: (r["n"], round(r["ndcg"], 4)) for r in evaluation.run_over(spark, f"{tmp_path}/in", ["a", "b"], read, scorer, f"{tmp_path}/cache", "m").collect()}
        assert out == {"a": (3, 0.6309), "b": (3, 1.0), None: (6, 0.8155)}
    assert spark.read.parquet(f"{tmp_path}/cache/m/a").count() == 3


def test_final_rows_are_checked_whatever_is_read(spark):
    for loss, score in (("other", 0.5), (None, 0.5), ("sft", 5.0)):
        rows = assemble.checked(spark.createDataFrame([("q", loss, score)], "query string, loss_type string, revised_score double"))
        for action in (rows.collect, rows.count, rows.select("query").collect):
            with pytest.raises(Exception, match="bad training row"):
                action()
    good = spark.createDataFrame([("q", "sft", None), ("q", "point-wise", 1.0)], "query string, loss_type string, revised_score double")
    assert assemble.checked(good).count() == 2


def test_provider_results(spark):
    kind = "extra struct<original_tavily_result:struct<answer:string,results:array<struct<title:string,content:string,raw_content:string>>>,original_zhipu_result:array<struct<title:string,content:string>>,original_exa_result:struct<results:array<struct<title:string,text:string>>>>"
    rows = [(1, ((" the answer ", [("t", "c", None)]), None, None)), (2, (None, [("t", " z ")], None)), (3, (None, None, ([("", "x")],))), (4, (None, None, (None,))), (5, (("  ", []), None, None))]
    df = spark.createDataFrame(rows, f"k int, {kind}")
    extra = F.col("extra")
    found = df.select("k", search.provider_results(extra).alias("r"), search.provider_answer(extra).alias("a"))
    docs = {r["k"]: r["docs"] for r in search.topk_documents(found, "k", F.col("r"), answer=F.col("a")).collect()}
    assert docs[1][0] == "the answer" and len(docs[1]) == 2 and docs[2][0].endswith("z") and docs[3] == ["x"] and set(docs) == {1, 2, 3}
    with pytest.raises(Exception, match="unknown search source"):
        spark.createDataFrame([(1, (None, None, None))], f"k int, {kind}").select(search.provider_results(extra)).collect()


def test_search_cap_and_decoration(spark):
    df = spark.createDataFrame([(1, [("t", f"c{i}", None) for i in range(12)]), (2, [("t", " ", None)])], "k int, r array<struct<title:string,content:string,raw_content:string>>")
    rows = search.topk_documents(df, "k", F.col("r")).collect()
    assert [(r["k"], len(r["docs"])) for r in rows] == [(1, 10)]


def test_jsonl_scans(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"query": "q", "pos_list": ["p"], "neg_list": []}\n\n{bad\n')
    schema = "query string, pos_list array<string>, neg_list array<string>"
    assert jsonl.lenient(spark, str(path), schema).count() == 1
    with pytest.raises(Exception):
        jsonl.strict(spark, str(path), schema).collect()
    for action in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("neg_list").collect()):
        with pytest.raises(Exception, match="malformed line"):
            action(jsonl.triples(spark, str(path)))
    assert [(r["line"], r["text"]) for r in jsonl.bad_lines(spark, str(path), schema).collect()] == [(3, "{bad")]
    for k, line in enumerate(('{"query": null, "pos_list": ["p"], "neg_list": []}', '{"query": "q", "pos_list": [], "neg_list": []}', '{"query": "q", "pos_list": ["p"], "neg_list": [null]}')):
        other = tmp_path / f"b{k}.txt"
        other.write_text(line + "\n")
        with pytest.raises(Exception, match=f"b{k}.txt"):
            jsonl.triples(spark, str(other)).count()
    array = tmp_path / "a.json"
    jsonl.write_array(spark.createDataFrame([(2, "b"), (1, None)], "k int, v string"), str(array), "k")
    assert json.loads(array.read_text()) == [{"k": 1, "v": None}, {"k": 2, "v": "b"}]
    assert sorted(map(tuple, jsonl.json_array(spark, str(array), "k int, v string").collect())) == [(1, None), (2, "b")]
    graded = tmp_path / "g.jsonl"
    graded.write_text('{"query": "q", "documents": [{"content": "d", "relevance": 1}]}\n')
    assert jsonl.sniffed(spark, str(graded)) == "documents" and jsonl.datasets(spark, str(tmp_path)) == ["a", "g"]
    assert jsonl.samples(spark, str(graded)).first()["relevance"] == [1.0]


def test_replace_and_upsert(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    jsonl.append(spark.createDataFrame([(1, "a")], "k int, v string"), path)
    for v in "bcd":
        jsonl.replace(spark.read.schema("k int, v string").json(jsonl.current(spark, path)).withColumn("v", F.lit(v)), path)
        assert [tuple(r) for r in spark.read.schema("k int, v string").json(jsonl.current(spark, path)).collect()] == [(1, v)]
    assert jsonl.versions(spark, path) == [2, 3]
    cache = f"file://{tmp_path}/cache"
    for v in ("x", "y"):
        out = jsonl.upsert(spark, spark.createDataFrame([(1, v)], "k int, v string"), cache, "k")
    assert [tuple(r) for r in out.collect()] == [(1, "y")]


def test_config():
    env = {"K_10": "c", "K_2": "b", "K_1": "a", "K_x": "no"}
    assert config.numbered(env, "K") == ["a", "b", "c"] and config.consecutive(env, "K") == ["a", "b"]
    assert config.from_mapping(config.Evaluation, {"data": {"datasets": "d"}, "models": ["m"]}).checked().run_tag == "neg7_seed42"
    with pytest.raises(ValueError):
        config.from_mapping(config.Evaluation, {"other": 1})


def test_stream_ingest_twice_is_once(spark, tmp_path):
    source, sink, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    for rows in ([(1,), (2,)], [(2,), (3,)]):
        spark.createDataFrame(rows, "k long").write.mode("append").json(source)
        incremental.ingest(spark, source, "k long", sink, mark, ["k"]).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(sink).collect()) == [1, 2, 3]
