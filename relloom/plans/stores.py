"""Queries on sources, sinks and whole runs: files are written to the shared folder and read again; clients are injected."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import text as tx
from ..functions.hashing import hash01
from ..operators import evaluation, pairs, retrieval, runner, sampling
from ..sources import jsonl
from ..sources import retrieval as benchmarks
from ..session import shared_folder, table
from . import fixtures as fx
from .fixtures import PAIRS, RERANK, h, r6

PLAIN = "doc_id long, lang string, n_chars long"


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def _plain(spark, sf):
    return fx.documents(spark, sf).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("n_chars").cast("long").alias("n_chars"))


def _lines(spark, sf):
    """doc_id, value: a JSON line of each document; each tenth is cut short."""
    rows = _plain(spark, sf)
    return rows.select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"))).otherwise(F.to_json(F.struct(*rows.columns))).alias("value"))


def jsonl_append_strict(spark, sf):
    """Documents appended in two jobs and read by the strict scan."""
    path, rows = shared_folder(spark, "strict"), _plain(spark, sf)
    for part in (0, 1):
        jsonl.append(rows.where(F.col("doc_id") % 2 == part), path)
    return jsonl.strict(spark, path, PLAIN)


def jsonl_lenient_counts(spark, sf):
    """Lines, rows that a lenient scan keeps, and the malformed ones that it shows."""
    path = shared_folder(spark, "lenient")
    _lines(spark, sf).select("value").write.text(path)
    whole = F.col("_corrupt_record").isNull()
    bad = jsonl.lenient(spark, path, PLAIN, keep_bad=True).agg(F.count("_corrupt_record").alias("bad"), F.count_if(whole & F.col("lang").isNotNull()).alias("with_lang"))
    good = jsonl.lenient(spark, path, PLAIN).agg(F.count("doc_id").alias("good"), F.sum("n_chars").alias("chars"))
    return good.crossJoin(F.broadcast(bad)).withColumn("lines", F.lit(jsonl.line_count(spark, path)).cast("long"))  # one row by one row


def jsonl_bad_lines(spark, sf):
    """Malformed lines by file and line, of files that hold 512 documents each."""
    path = shared_folder(spark, "bad")
    rows = _lines(spark, sf).withColumn("part", F.floor(F.col("doc_id") / 512))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("value", "part").write.partitionBy("part").text(path)
    found = jsonl.bad_lines(spark, path, PLAIN)
    return found.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "line", "text")


def jsonl_samples(spark, sf):
    """Both formats of graded samples, by the format that is found in the file; both names of the grade."""
    base, rows = shared_folder(spark, "samples"), fx.pairs(spark, sf)
    jsonl.append(rows.select("query", F.array("document").alias("pos_list"), F.array("k", "query").alias("neg_list")), f"{base}/one")
    doc = lambda text, a, b: F.struct(text.alias("content"), a.alias("relevance_score"), b.alias("relevance"))
    none = F.lit(None).cast("double")
    docs = F.array(doc(F.col("document"), F.round("score", 3), none), doc(F.col("k"), none, F.lit(0.25)))
    jsonl.append(rows.select("query", docs.alias("documents")), f"{base}/two")
    out = [jsonl.samples(spark, f"{base}/{name}").withColumn("format", F.lit(jsonl.sniffed(spark, f"{base}/{name}"))) for name in ("one", "two")]
    return out[0].unionByName(out[1]).select("format", F.sha2(F.concat_ws("\n", "query", F.array_join("documents", "\n")).cast("binary"), 256).alias("digest"), F.array_join(F.transform("relevance", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("grades"))


def jsonl_merged(spark, sf):
    """Named datasets of a folder in one table with their names; one that isn't there is skipped."""
    base, rows = shared_folder(spark, "merged"), _plain(spark, sf)
    for k, name in enumerate("abc"):
        jsonl.append(rows.where(F.col("doc_id") % 3 == k), f"{base}/{name}.jsonl")
    return jsonl.merged(spark, base, ["a", "c", "none"], PLAIN).select("doc_id", "src", F.lit(",".join(jsonl.datasets(spark, base))).alias("datasets"))


def json_array_file(spark, sf):
    """A report of a row for each language as one JSON array."""
    path = shared_folder(spark, "array") + "/report.json"
    jsonl.write_array(_plain(spark, sf).groupBy("lang").agg(F.count("*").alias("n")), path, "lang")
    return jsonl.json_array(spark, path, "lang string, n long")


def replaced_rows(spark, sf):
    """A store whose rows are read, changed and put in their own place, twice."""
    path, rows = shared_folder(spark, "replaced"), _plain(spark, sf)
    jsonl.append(rows, path)
    for _ in range(2):
        now = jsonl.strict(spark, jsonl.current(spark, path), PLAIN)
        jsonl.replace(now.where("doc_id % 5 <> 0").withColumn("n_chars", F.col("n_chars") + 1), path)
    return jsonl.strict(spark, jsonl.current(spark, path), PLAIN)


def value_cache(spark, sf):
    """A cache written twice: the last value of a key counts."""
    path, rows = shared_folder(spark, "cache"), _plain(spark, sf).select("doc_id", "n_chars")
    jsonl.upsert(spark, rows, path, "doc_id")
    return jsonl.upsert(spark, rows.where("doc_id % 3 = 0").withColumn("n_chars", -F.col("n_chars")), path, "doc_id")


def hub_benchmark(spark, sf):
    """Corpus, queries and judgements in a hub's folders; only queries with a positive judgement stay."""
    base, pages = shared_folder(spark, "hub"), fx.search(spark, sf)
    pages.select(F.col("page_id").alias("_id"), "title", F.col("content").alias("text")).write.parquet(f"{base}/corpus")
    pages.select(F.col("page_id").alias("_id"), F.col("url").alias("text")).write.parquet(f"{base}/queries")
    qrels = pages.select(F.col("page_id").alias("query-id"), F.col("page_id").alias("corpus-id"), (F.col("page_id") % 3).alias("score"))
    qrels.where("score = 2").write.parquet(f"{base}/qrels/dev")
    qrels.write.parquet(f"{base}/qrels/test")
    got = benchmarks.read(spark, base)
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    rows = got.corpus.select(F.lit("corpus").alias("kind"), F.col("doc_id").alias("id"), digest).union(got.queries.select(F.lit("query"), "query_id", digest))
    return rows.union(got.qrels.select(F.lit("grade"), "query_id", F.col("score").cast("string")))


def graded_last_wins(spark, sf):
    """Retrieved pairs with judgements that are given twice: the last one counts, none is 0."""
    found = fx.found(spark, sf, 5)
    twice = F.array(*[F.struct(F.lit(k).alias("ord"), ((F.col("vec_id") + k) % 4).cast("int").alias("relevance")) for k in range(2)])
    qrels = found.where("vec_id % 2 = 0").select("query_id", "vec_id", F.explode(twice).alias("x")).select("query_id", "vec_id", "x.*")
    return retrieval.graded(found, qrels).select("query_id", "vec_id", "relevance")


def positive_texts(spark, sf):
    """Texts of positive ids in the judgements' order; an id that occurs twice has its last text, a missing one none."""
    pages = fx.search(spark, sf)
    corpus = pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"), F.lit(0).alias("ord")).union(pages.where("page_id % 4 = 0").select("page_id", F.concat("url", F.lit("#")), F.lit(1)))
    qrels = pages.select((F.col("page_id") / 3).cast("long").alias("query_id"), (F.col("page_id") + 1).alias("doc_id"), (F.col("page_id") % 5).alias("score"), (-F.col("page_id")).alias("ord"))
    return retrieval.positive_texts(qrels, corpus).select("query_id", F.array_join("pos_list", "\n").alias("texts"))


def _labeller(name: str):
    """Mostly yes or no by a hash; every eighth answer is missing."""

    def client(prompts):
        found = [_md5(f"{name}|{p}") for p in prompts]
        return [None if x[0] in "01" else "Yes, it is." if x[1] < "8" else "no" for x in found]

    return client


def annotation_run(spark, sf):
    """Five models in turn; pairs that three agree on aren't asked any more."""
    rows = fx.pairs(spark, sf).select("k", F.concat(F.lit("p "), "k").alias("prompt"))
    models = {f"m{i}": _labeller(f"m{i}") for i in range(5)}
    return runner.voted(spark, rows, shared_folder(spark, "votes"), "k", "prompt", models)


def teacher_run(spark, sf):
    """Every pair scored by a client in three committed rounds; then again, when only those without an answer are asked."""
    rows = fx.pairs(spark, sf).select("k", F.concat_ws("\n", "query", "document").alias("prompt"))
    path = shared_folder(spark, "teacher")
    runner.run_in_rounds(spark, rows, path, "k", "prompt", "answer", lambda ps: [None if _md5(p)[0] == "0" else _md5(p) for p in ps], 3, retries=0)
    again = runner.run_resumed(spark, rows, path, "k", "prompt", "answer", lambda ps: ["late" for _ in ps])
    return again.select("k", "answer")


def repair_run(spark, sf):
    """Answers that don't fit are asked again by a second and a third client; the last one stays, good or bad."""
    rows = fx.pairs(spark, sf).select("k", F.md5(F.col("k").cast("binary")).alias("answer"))
    wrong = F.col("answer").isNull() | (F.substring("answer", 1, 1) < "8")
    clients = [lambda ps, n=n: [None if _md5(f"{n}{p}")[1] == "0" else _md5(f"{n}{p}") for p in ps] for n in (1, 2)]
    return runner.repaired(rows, "k", "answer", wrong, clients).select("k", "answer")


def flag_filter_run(spark, sf):
    """Texts that a client flags go; null texts stay."""
    rows = fx.documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.concat("lang", F.lit(":"), "source", F.lit(":"), (F.col("doc_id") % 50).cast("string"))).alias("topic"))
    return runner.flagged_out(spark, rows, shared_folder(spark, "flags"), "topic", lambda ps: ["Yes" if _md5(p)[0] < "4" else "no" for p in ps])


def keyword_run(spark, sf):
    """Keywords from a client's answers: in an element or plain; refused ones are dropped."""

    def client(prompts):
        return [("<keywords> a b " + p + " </keywords>", "SKIP", " skip ", "one two three four five six seven eight", "x " + p)[int(_md5(p)[:2], 16) % 5] for p in prompts]

    rows = fx.pairs(spark, sf).select("k", F.concat(F.lit("q"), "k").alias("prompt"))
    found = runner.run_resumed(spark, rows, shared_folder(spark, "keywords"), "k", "prompt", "answer", client)
    return found.select("k", tx.keywords_of("answer").alias("keywords")).where(~tx.refused_keywords("keywords"))


def translated_texts(spark, sf):
    """Languages' names translated; where that fails, as they were."""

    def client(prompts):
        return [None if p in ("src0", "src1") else p.upper() for p in prompts]

    rows = fx.documents(spark, sf).select("source").where("source is not null").distinct()
    return runner.translated(rows.withColumn("text", F.col("source")), "text", client)


def scattered_shards(spark, sf):
    """Rows dealt to four shards, each worked on by itself, and put together again."""
    rows = runner.scattered(fx.documents(spark, sf).select("doc_id", "lang"), "doc_id", 4)
    parts = [rows.where(F.col("shard") == s).withColumn("by", F.concat(F.lit(f"{s}"), "lang")) for s in range(4)]
    return runner.collated(parts, "doc_id")


def macro_means(spark, sf):
    """Rerank results of each dataset kept in a cache, then the means of all and the macro mean, as the report gives them."""
    path, rows = shared_folder(spark, "macro"), evaluation.ndcg_by_query(fx.rerank(spark, sf), ["dataset", "model", "query_id"])
    results = rows.groupBy("dataset", "model").agg(F.avg("ndcg").alias("ndcg")).withColumn("key", F.concat_ws("|", F.col("dataset").cast("string"), "model"))
    jsonl.upsert(spark, results.withColumn("ndcg", F.lit(-1.0)).where("model = 'rr2'"), path, "key")
    cached = jsonl.upsert(spark, results, path, "key")
    return evaluation.report(cached, ["rr1", "rr2"]).select("dataset", r6("rr1"), r6("rr2"))


def instruction_split(spark, sf):
    """Raw triples whose query follows an instruction; rows without the mark or without texts on either side go."""
    mark = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("I\n Query: "), "query")).when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" I\n Query: "), F.lit(" y "))).otherwise(F.col("query"))
    rows = fx.pairs(spark, sf).select("k", mark.alias("query"), F.array(F.concat(F.lit(" "), "k"), F.lit(" ")).alias("pos"), F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("n"), "k")).alias("neg"))
    found = pairs.split_instruction(rows, "query", "pos", "neg")
    return found.select("k", F.sha2(F.col("query").cast("binary"), 256).alias("digest"), F.array_join("pos", ",").alias("pos"), F.array_join("neg", ",").alias("neg"))


def valid_instructions(spark, sf):
    """First turns in wanted languages with an allowed last category."""
    d = F.col("doc_id")
    label = F.struct(F.when(d % 7 == 0, F.array().cast("array<string>")).when(d % 2 == 0, F.array(F.lit("x"), F.concat(F.lit("c"), (d % 5).cast("string")))).otherwise(F.array(F.lit("c9"))).alias("cate_ability_zh"))
    turns = F.when(d % 11 == 0, F.array(F.struct(F.lit(" ").alias("value")))).otherwise(F.array(F.struct(F.concat(F.lit(" i"), d.cast("string")).alias("value"))))
    rows = fx.documents(spark, sf).select(turns.alias("conversations"), F.col("lang").alias("langdetect"), label.alias("label"))
    return pairs.valid_instructions(rows, ["en", "de"], ["c4", "c9"]).union(pairs.valid_instructions(rows, ["en"], ["c0"]))


def score_expressions(spark, sf):
    """Softmax of two log probabilities, one of which may be missing; squared loss of a sigmoid; null-safe matches."""
    rows = fx.documents(spark, sf).select("doc_id", (-3 * hash01("a", "doc_id")).alias("a"), F.when(F.col("doc_id") % 4 != 0, -3 * hash01("b", "doc_id")).alias("b"), F.when(F.col("doc_id") % 3 != 0, F.lit("yes")).alias("l"), F.when(F.col("doc_id") % 6 != 0, F.lit("yes")).alias("r"))
    return rows.select("doc_id", F.round(metrics.yes_probability("a", "b"), 6).alias("p"), F.round(metrics.squared_sigmoid_loss("a", F.lit(0.5)), 6).alias("loss"), metrics.matches("l", "r").alias("match"))


def query_shapes(spark, sf):
    """Cut and instructed queries, names of models and files, estimated lengths."""
    rows = fx.pairs(spark, sf)
    path = F.concat(F.lit("org/part: "), "k", F.lit("/x"))
    return rows.select(
        "k", tx.cut_query("query", 30).alias("cut"), F.length(tx.instructed("query", "m", "Find: ", ("m",))).alias("with"), F.length(tx.instructed("query", "n", "Find: ", ("m",))).alias("without"),
        tx.model_name(path).alias("model"), tx.safe_name(path).alias("safe"), tx.estimated_tokens(F.length("document")).cast("long").alias("estimate"),
    )


def grouped_positions(spark, sf):
    """Rows of a query side by side, queries in a random order that repeats."""
    rows = sampling.grouped_order(fx.pairs(spark, sf).select("k", F.col("conv_id").cast("string").alias("conv")), "conv", "k", "order")
    return rows.select("k", "conv")


QUERIES = {f.__name__: f for f in (jsonl_append_strict, jsonl_lenient_counts, jsonl_bad_lines, jsonl_samples, jsonl_merged, json_array_file, replaced_rows, value_cache, hub_benchmark, graded_last_wins, positive_texts, annotation_run, teacher_run, repair_run, flag_filter_run, keyword_run, translated_texts, scattered_shards, macro_means, instruction_split, valid_instructions, score_expressions, query_shapes, grouped_positions)}

_LINE = "CASE WHEN doc_id % 10 = 0 THEN '{\"doc_id\": ' || doc_id END"
_GRADES = "CAST(round(round(score, 3) * 1000) AS BIGINT) || ',250'"
_VOTE = lambda m: f"CASE WHEN left(md5('{m}|p ' || k), 1) IN ('0', '1') THEN NULL WHEN substr(md5('{m}|p ' || k), 2, 1) < '8' THEN 1 ELSE 0 END AS {m}"
_SUM = lambda n, v: " + ".join(f"coalesce((m{i} = {v})::BIGINT, 0)" for i in range(n))
_KEYWORDS = "('0x' || left(md5('q' || k), 2))::BIGINT % 5"

ORACLE_SQL = {
    "jsonl_append_strict": "SELECT doc_id, lang, n_chars::BIGINT AS n_chars FROM documents",
    "jsonl_lenient_counts": "SELECT count(*) AS lines, count(*) FILTER (doc_id % 10 <> 0) AS good, sum(n_chars) FILTER (doc_id % 10 <> 0)::BIGINT AS chars, count(*) FILTER (doc_id % 10 = 0) AS bad, count(lang) FILTER (doc_id % 10 <> 0) AS with_lang FROM documents",
    "jsonl_bad_lines": f"WITH r AS (SELECT doc_id // 512 AS part, row_number() OVER (PARTITION BY doc_id // 512 ORDER BY doc_id) AS line, {_LINE} AS text FROM documents) SELECT * FROM r WHERE text IS NOT NULL",
    "jsonl_samples": f"""WITH {PAIRS} SELECT 'pos_neg' AS format, sha256(query || chr(10) || document || chr(10) || k || chr(10) || query) AS digest, '1000,0,0' AS grades FROM pairs
        UNION ALL SELECT 'documents', sha256(query || chr(10) || document || chr(10) || k), {_GRADES} FROM pairs""",
    "jsonl_merged": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a' ELSE 'c' END AS src, 'a,b,c' AS datasets FROM documents WHERE doc_id % 3 <> 1",
    "json_array_file": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "replaced_rows": "SELECT doc_id, lang, n_chars::BIGINT + 2 AS n_chars FROM documents WHERE doc_id % 5 <> 0",
    "value_cache": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -n_chars ELSE n_chars END::BIGINT AS n_chars FROM documents",
    "hub_benchmark": f"""WITH {fx.SEARCH} SELECT 'corpus' AS kind, page_id AS id, sha256(CASE WHEN {fx.strip('title')} <> '' THEN {fx.strip('title')} || ' ' || content ELSE content END) AS digest FROM search
        UNION ALL SELECT 'query', page_id, sha256(url) FROM search WHERE page_id % 3 > 0 UNION ALL SELECT 'grade', page_id, (page_id % 3)::VARCHAR FROM search""",
    "graded_last_wins": f"WITH {fx.FOUND} SELECT query_id, vec_id, CASE WHEN vec_id % 2 = 0 THEN (vec_id + 1) % 4 ELSE 0 END::INTEGER AS relevance FROM found WHERE rank <= 5",
    "positive_texts": """SELECT q.page_id // 3 AS query_id, string_agg(c.url || CASE WHEN c.page_id % 4 = 0 THEN '#' ELSE '' END, chr(10) ORDER BY q.page_id DESC) AS texts
        FROM pages q JOIN pages c ON c.page_id = q.page_id + 1 WHERE q.page_id % 5 > 0 GROUP BY 1""",
    "annotation_run": f"""WITH {PAIRS}, v AS (SELECT k, {', '.join(_VOTE(f'm{i}') for i in range(5))} FROM pairs),
        c AS (SELECT k, CASE WHEN greatest({_SUM(3, 1)}, {_SUM(3, 0)}) >= 3 THEN 3 WHEN greatest({_SUM(4, 1)}, {_SUM(4, 0)}) >= 3 THEN 4 ELSE 5 END AS asked, {', '.join(f'{_SUM(n, x)} AS {w}{n}' for n in (3, 4, 5) for x, w in ((1, 'y'), (0, 'n')))} FROM v),
        d AS (SELECT k, CASE asked WHEN 3 THEN y3 WHEN 4 THEN y4 ELSE y5 END AS yes_votes, CASE asked WHEN 3 THEN n3 WHEN 4 THEN n4 ELSE n5 END AS no_votes FROM c)
        SELECT k, yes_votes, no_votes, CASE WHEN yes_votes >= 3 THEN 'yes' WHEN no_votes >= 3 THEN 'no' END AS annotated_label FROM d""",
    "teacher_run": f"WITH {PAIRS}, p AS (SELECT k, md5(query || chr(10) || document) AS a FROM pairs) SELECT k, CASE WHEN left(a, 1) = '0' THEN 'late' ELSE a END AS answer FROM p",
    "repair_run": f"""WITH {PAIRS}, a AS (SELECT k, md5(k) AS a0, CASE WHEN substr(md5('1' || k), 2, 1) <> '0' THEN md5('1' || k) END AS a1, CASE WHEN substr(md5('2' || k), 2, 1) <> '0' THEN md5('2' || k) END AS a2, md5('1' || k) AS _1 FROM pairs)
        SELECT k, CASE WHEN left(a0, 1) >= '8' THEN a0 WHEN left(a1, 1) >= '8' THEN a1 ELSE a2 END AS answer FROM a""",
    "flag_filter_run": "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN lang || ':' || source || ':' || doc_id % 50 END AS topic FROM documents) SELECT doc_id, topic FROM t WHERE topic IS NULL OR left(md5(topic), 1) >= '4'",
    "keyword_run": f"WITH {PAIRS} SELECT k, CASE {_KEYWORDS} WHEN 0 THEN 'a b q' || k ELSE 'x q' || k END AS keywords FROM pairs WHERE {_KEYWORDS} IN (0, 4)",
    "translated_texts": "SELECT DISTINCT source, CASE WHEN source IN ('src0', 'src1') THEN source ELSE upper(source) END AS text FROM documents WHERE source IS NOT NULL",
    "scattered_shards": "SELECT doc_id, lang, (doc_id % 4)::INTEGER AS shard, (doc_id % 4) || lang AS by FROM documents",
    "macro_means": f"""WITH {RERANK}, {fx.NDCG}, m AS (SELECT dataset, model, avg(ndcg) AS ndcg FROM ndcg GROUP BY ALL)
        SELECT dataset::VARCHAR AS dataset, round(max(ndcg) FILTER (model = 'rr1'), 6) AS rr1, round(max(ndcg) FILTER (model = 'rr2'), 6) AS rr2 FROM m GROUP BY dataset
        UNION ALL SELECT 'AVERAGE', round(avg(ndcg) FILTER (model = 'rr1'), 6), round(avg(ndcg) FILTER (model = 'rr2'), 6) FROM m""",
    "instruction_split": f"""WITH {PAIRS}, q AS (SELECT k, conv_id, CASE WHEN turn % 4 = 0 THEN 'I' || chr(10) || ' Query: ' || query WHEN conv_id % 2 = 0 THEN ' I' || chr(10) || ' Query:  y ' ELSE query END AS raw FROM pairs),
        s AS (SELECT k, conv_id, string_split({fx.strip('raw')}, chr(10) || ' Query: ') AS p FROM q)
        SELECT k, sha256({fx.strip('p[2]')}) AS digest, k AS pos, 'n,' || k AS neg FROM s WHERE len(p) = 2 AND length({fx.strip('p[2]')}) >= 2 AND conv_id % 3 <> 0""",
    "valid_instructions": """WITH t AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'c' || doc_id % 5 ELSE 'c9' END AS cate FROM documents WHERE doc_id % 11 <> 0)
        SELECT 'i' || doc_id AS instruction, lang, cate FROM t WHERE lang IN ('en', 'de') AND cate NOT IN ('c4', 'c9') UNION ALL SELECT 'i' || doc_id, lang, cate FROM t WHERE lang = 'en' AND cate <> 'c0'""",
    "score_expressions": f"""WITH t AS (SELECT doc_id, -3 * {h('a', 'doc_id')} AS a, CASE WHEN doc_id % 4 <> 0 THEN -3 * {h('b', 'doc_id')} ELSE -10 END AS b FROM documents)
        SELECT doc_id, round(exp(a) / (exp(a) + exp(b)), 6) AS p, round(pow(1 / (1 + exp(-a)) - 0.5, 2), 6) AS loss, CASE WHEN (doc_id % 3 = 0) = (doc_id % 6 = 0) THEN 'yes' ELSE 'no' END AS match FROM t""",
    "query_shapes": f"""WITH {PAIRS} SELECT k, left(query, 30) AS cut, length(query)::INTEGER + 6 AS with, length(query)::INTEGER AS without, 'part: ' || k || '/x' AS model, 'org__part__' || k || '__x' AS safe, greatest(length(document) // 3, 100) AS estimate FROM pairs""",
    "grouped_positions": f"WITH {PAIRS} SELECT k, conv_id::VARCHAR AS conv FROM pairs",
}
