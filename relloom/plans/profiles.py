"""Queries on texts, profiles, thresholds, events and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import batches_by_budget
from ..functions.hashing import hash01
from ..operators import calibrate, evaluation, pairs, profile, sampling, search
from ..session import shared_folder, table
from ..streaming import incremental
from . import fixtures as fx
from .fixtures import PAIRS, SCORED, SEARCH, h, md5, r6

PERCENTS = [50, 90, 95, 99]


def script_profile(spark, sf):
    counts = [tx.script_count("text", s).alias(s) for s in tx.SCRIPTS]
    return fx.scripted(spark, sf).select("doc_id", *counts, tx.dominant_script("text").alias("dominant"), tx.language("text").alias("language"), tx.is_ascii("text").alias("ascii"), tx.has_cjk("text").alias("has_cjk"))


def script_mismatch(spark, sf):
    """Texts against others in tags: a tag's letters don't count, so a tagged Chinese text isn't Latin."""
    one = fx.scripted(spark, sf)
    other = one.select((F.col("doc_id") + 1).alias("doc_id"), F.concat(F.lit("<contribution>"), F.col("text"), F.lit("</Evidence>")).alias("tagged"))
    rows = one.join(other, "doc_id").groupBy(tx.dominant_script("text").alias("a"), tx.dominant_script(tx.without_tags("tagged")).alias("b"), tx.same_script("text", "tagged").alias("same"))
    return rows.agg(F.count("*").alias("n")).where("not same").drop("same")


def b64_run_filter(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.base64_run("html").alias("run")).where("run < 1000")


def search_topk_docs(spark, sf):
    """Results grouped by host, twelve at most entering, ten at most leaving."""
    rows = fx.search(spark, sf).withColumn("bucket", (F.col("page_id") / 12).cast("long"))
    lists = rows.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("page_id", "title", "content", "raw_content"))).alias("results"))
    docs = search.topk_documents(lists, "bucket", F.col("results"))
    return docs.select("bucket", F.size("docs").alias("n"), F.sha2(F.array_join(F.array_sort("docs"), "\n").cast("binary"), 256).alias("digest"))


def title_concat(spark, sf):
    return fx.search(spark, sf).select("page_id", F.sha2(tx.title_text("title", "content").cast("binary"), 256).alias("digest"))


def token_truncate_discard(spark, sf):
    """Documents are cut, some pairs are still too long; what is kept is the original text."""
    rows = pairs.truncated_pairs(fx.pairs(spark, sf), "query", "document", 20, 40)
    return rows.select("k", "was_cut", tx.token_count("document").alias("n_tokens"), F.sha2(F.col("document").cast("binary"), 256).alias("digest"))


def batch_ids_by_char_budget(spark, sf):
    """Greedy batches of the candidate texts of each block of twenty documents."""
    rows = fx.documents(spark, sf).select((F.col("doc_id") / 20).cast("long").alias("list"), "doc_id", F.greatest(F.floor(F.col("n_chars") / 3), F.lit(1)).alias("size"))
    lists = rows.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("doc_id", "size"))).alias("x"))
    lists = lists.withColumn("batch", batches_by_budget(F.col("x.size"), F.lit(10), 5000, 6))
    return lists.select(F.explode(F.arrays_zip(F.col("x.doc_id").alias("doc_id"), F.col("batch").alias("batch"))).alias("z")).select("z.doc_id", "z.batch")


def profile_summary(spark, sf):
    rows = profile.summary(fx.documents(spark, sf), ["lang"], "n_chars")
    return rows.select("lang", "n", "least", "most", r6("mean"), "median", r6("sd"))


def percentile_nearest(spark, sf):
    return profile.nearest_percentiles(fx.documents(spark, sf), ["lang"], "n_chars", PERCENTS)


def percentile_linear(spark, sf):
    return profile.linear_percentiles(fx.documents(spark, sf), ["lang"], "n_chars", PERCENTS).select("lang", "p", r6("value"))


def freq_of_freq(spark, sf):
    one = profile.counts_of_counts(fx.pairs(spark, sf), "query").select(F.lit("query").alias("what"), "size", "n")
    return one.union(profile.counts_of_counts(table(spark, sf, "events"), "user_id").select(F.lit("user"), "size", "n"))


def duplicate_pairs(spark, sf):
    return profile.duplicates(fx.documents(spark, sf).select(F.sha2(F.col("text").cast("binary"), 256).alias("key")), ["key"])


def score_vs_length(spark, sf):
    return profile.bucketed(fx.scored(spark, sf), "score", "n_chars", 0.1).select("bucket", "n", r6("mean"), "median")


def topn_counter(spark, sf):
    return profile.top_counts(table(spark, sf, "events"), "user_id", "event_id", 15)


def lang_cate_grouping_sets(spark, sf):
    return profile.grouped_counts(fx.documents(spark, sf), "lang", "source")


def pair_reuse(spark, sf):
    return profile.reuse(fx.pairs(spark, sf), "query", "document").select("n", "n_one", "n_two", r6("per_one"), r6("per_two"))


def _class_scores(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("positive"))
    return rows.withColumn("score", F.when(F.col("positive"), 1 - F.pow(hash01("s2", "doc_id"), F.lit(2.0))).otherwise(F.pow(hash01("s2", "doc_id"), F.lit(2.0))))


def threshold_sweep(spark, sf):
    return calibrate.sweep(_class_scores(spark, sf)).select("level", "hits_above", "hits_below", *[r6(c) for c in ("precision_above", "recall_above", "precision_below", "recall_below")])


def threshold_sweep_exact(spark, sf):
    """Scores of two decimals, all of which are thresholds themselves."""
    rows = _class_scores(spark, sf).withColumn("score", F.floor(F.col("score") * 100) / F.lit(100.0))
    return calibrate.sweep(rows).select("level", "hits_above", "hits_below", *[r6(c) for c in ("precision_above", "recall_above", "precision_below", "recall_below")])


def threshold_calibration(spark, sf):
    rows = calibrate.calibrated(_class_scores(spark, sf), "doc_id", [0.9, 0.5], [0.1, 0.5], points=2001)
    return rows.select("direction", "level", F.round("threshold", 4).alias("threshold"), r6("precision"), r6("recall"), "hits")


def threshold_summary(spark, sf):
    rows = calibrate.summary(_class_scores(spark, sf))
    return rows.select("positive", "n", *[r6(c) for c in rows.columns[2:]])


def search_provider_docs(spark, sf):
    """Responses of three providers: the answer first, no list of results no row, raw text from one provider only."""
    rows = fx.answers(spark, sf).select("bucket", search.provider_results(F.col("extra")).alias("results"), search.provider_answer(F.col("extra")).alias("answer"))
    docs = search.topk_documents(rows, "bucket", F.col("results"), answer=F.col("answer"))
    return docs.select("bucket", F.size("docs").alias("n"), F.sha2(F.array_join(F.array_sort("docs"), "\n").cast("binary"), 256).alias("digest"))


def unquoted_queries(spark, sf):
    """Model outputs in quotes of either kind, nested, blank and 'none'."""
    kinds = ["'q'", "\" 'q' \"", "\"q", "\"", "\"None\"", "'' q ''", "q", " \" none' "]
    rows = fx.documents(spark, sf).select("doc_id", F.get(F.array(*map(F.lit, kinds)), (F.col("doc_id") % len(kinds)).cast("int")).alias("q"))
    return rows.select("doc_id", tx.unquoted(F.replace("q", F.lit("q"), F.concat(F.lit("x"), F.col("doc_id").cast("string")))).alias("text"))


def quota_errors(spark, sf):
    rows = fx.documents(spark, sf).select("doc_id", F.get(F.array(*map(F.lit, ["Quota EXCEEDED today", "credits left", "limit reached", "usage limit", "timeout"])), (F.col("doc_id") % 5).cast("int")).alias("m"), F.when(F.col("doc_id") % 7 == 0, "ExaUsageLimitError").alias("name"))
    return rows.select("doc_id", tx.quota_error("m", "name").alias("quota"))


def length_sorted_batches(spark, sf):
    rows = sampling.length_batches(fx.documents(spark, sf).select("doc_id", "text"), F.coalesce(F.length("text"), F.lit(0)), "doc_id", 32)
    return rows.select("doc_id", "position", "batch")


def length_profile(spark, sf):
    """Sizes of queries, of documents and of both as a list."""
    rows = fx.pairs(spark, sf).withColumn("both", F.array("query", "document"))
    found = profile.lengths(rows, {"query": "query", "document": "document", "all": "both"}, tx.token_count)
    return found.select("field", "n", "least", "most", r6("mean"), *[r6(c) for c in found.columns if c[0] == "p"])


def rank_weighted_means(spark, sf):
    """Events as ranks' sums and counts."""
    rows = table(spark, sf, "events").groupBy((F.col("event_id") % 8).alias("rank")).agg(F.sum("value").alias("loss"), F.count("*").alias("n"), F.sum(F.when(F.col("user_id") < 0, F.col("value")).otherwise(0.0)).alias("none"), F.count_if(F.col("user_id") < 0).alias("n_none"))
    return evaluation.rank_means(rows, {"loss": "n", "none": "n_none"}).select(r6("loss"), r6("none"))


def kde_thresholds(spark, sf):
    return calibrate.thresholds(_class_scores(spark, sf), [0.1, 0.25, 0.5, 0.75, 0.9]).select("level", F.round("threshold", 3).alias("threshold"))


def numbered_list_parse(spark, sf):
    text = F.concat(F.lit("1. alpha\n2、 beta\n3) "), F.when(F.col("page_id") % 2 == 0, "gamma").otherwise("none such"), F.when(F.col("page_id") % 3 == 0, "\n4. alpha\n5. alpha").otherwise(""))
    labels = tx.numbered_list(text, 4, ["alpha", "beta", "gamma"], "other")
    return table(spark, sf, "pages").select("page_id", F.array_join(labels, ",").alias("labels"))


def rate_window_requests(spark, sf):
    return incremental.trailing(table(spark, sf, "events")).select("event_id", "n_trailing")


def rate_window_tokens(spark, sf):
    return incremental.trailing(table(spark, sf, "events")).select("event_id", r6("sum_trailing"))


def tumbling_events(spark, sf):
    rows = incremental.tumbling(table(spark, sf, "events"))
    return rows.select("event_type", F.unix_seconds("start").alias("start"), "n", r6("total"))


def session_events(spark, sf):
    rows = incremental.sessions(table(spark, sf, "events"))
    return rows.select("user_id", F.unix_micros("start").alias("start"), "n")


def stream_resume(spark, sf):
    """Documents as JSON files in two arrivals, ingested twice; the sink holds each key once."""
    from ..sources.jsonl import encoded

    base = shared_folder(spark, "stream")
    docs = fx.documents(spark, sf).select("doc_id", "lang")
    for part in (docs.where("doc_id % 2 = 0"), docs):
        encoded(part).write.mode("append").text(f"{base}/in")
        incremental.ingest(spark, f"{base}/in", "doc_id long, lang string", f"{base}/out", f"{base}/checkpoint", ["doc_id"]).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id", "lang")


QUERIES = {f.__name__: f for f in (script_profile, script_mismatch, b64_run_filter, search_topk_docs, title_concat, token_truncate_discard, batch_ids_by_char_budget, profile_summary, percentile_nearest, percentile_linear, freq_of_freq, duplicate_pairs, score_vs_length, topn_counter, lang_cate_grouping_sets, pair_reuse, threshold_sweep, threshold_sweep_exact, threshold_calibration, threshold_summary, search_provider_docs, unquoted_queries, quota_errors, length_sorted_batches, length_profile, rank_weighted_means, kde_thresholds, numbered_list_parse, rate_window_requests, rate_window_tokens, tumbling_events, session_events, stream_resume)}

#: The scripts' ranges once more, so that the SQL doesn't follow the engine's table.
_RANGES = {"cjk": "\u4e00-\u9fff\u3400-\u4dbf", "latin": "A-Za-z", "hangul": "\uac00-\ud7af\u1100-\u11ff", "kana": "\u3040-\u309f\u30a0-\u30ff"}
_COUNT = {s: lambda x, r=r: f"length(regexp_replace({x}, '[^{r}]', '', 'g'))" for s, r in _RANGES.items()}


def _dominant(x: str) -> str:
    n = {s: c(x) for s, c in _COUNT.items()}
    most = f"greatest({', '.join(n.values())})"
    return f"CASE WHEN {most} = 0 THEN 'unknown' " + " ".join(f"WHEN {c} = {most} THEN '{s}'" for s, c in n.items()) + " END"


_CLASS = f"scores AS (SELECT doc_id, quality = 1 AS positive, CASE WHEN quality = 1 THEN 1 - pow({h('s2', 'doc_id')}, 2) ELSE pow({h('s2', 'doc_id')}, 2) END AS score FROM labels)"
_U = lambda seed: h(f"search-{seed}", "concat(bucket, '.', i)")

_SWEEP = """l AS (SELECT unnest(range(101)) AS level, unnest(range(101)) / 100::DOUBLE AS t),
        c AS (SELECT level, count(*) FILTER (positive AND score >= t) AS pa, count(*) FILTER (NOT positive AND score >= t) AS na, count(*) FILTER (positive AND score <= t) AS pb, count(*) FILTER (NOT positive AND score <= t) AS nb, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM l, scores GROUP BY level)
        SELECT level::INTEGER AS level, pa + na AS hits_above, pb + nb AS hits_below, round(CASE WHEN pa + na > 0 THEN pa / (pa + na)::DOUBLE ELSE 0 END, 6) AS precision_above, round(CASE WHEN p > 0 THEN pa / p::DOUBLE ELSE 0 END, 6) AS recall_above,
            round(CASE WHEN pb + nb > 0 THEN nb / (pb + nb)::DOUBLE ELSE 0 END, 6) AS precision_below, round(CASE WHEN n > 0 THEN nb / n::DOUBLE ELSE 0 END, 6) AS recall_below FROM c"""


def _curve(scores: str, low: str, high: str, points: int, bin_width: str = "1e-4") -> str:
    """SQL for i, x, y: the posterior of the positive class on a grid."""
    return f"""b AS (SELECT positive, round(score / {bin_width}::DOUBLE) * {bin_width}::DOUBLE AS s, count(*) AS w FROM {scores} GROUP BY ALL),
        k AS (SELECT positive, count(*) AS n, pow(count(*)::DOUBLE, -0.2::DOUBLE) * stddev_samp(score) AS h FROM {scores} GROUP BY positive),
        g AS (SELECT i, {low} + i * (({high} - {low}) / {points - 1}) AS x FROM range({points}) t(i)),
        d AS (SELECT i, x, sum(CASE WHEN positive THEN w * exp(-((x - s) / h) * ((x - s) / h) / 2) / (n * h * sqrt(2 * pi())) ELSE 0 END) AS p, sum(CASE WHEN NOT positive THEN w * exp(-((x - s) / h) * ((x - s) / h) / 2) / (n * h * sqrt(2 * pi())) ELSE 0 END) AS q FROM g, b JOIN k USING (positive) GROUP BY ALL),
        y AS (SELECT i, x, p * 0.125 / (p * 0.125 + q * 0.875) AS y FROM d WHERE p * 0.125 + q * 0.875 > 0),
        z AS (SELECT *, lead(x) OVER (ORDER BY i) AS x1, lead(y) OVER (ORDER BY i) AS y1 FROM y)"""


_TOKENS = "len(regexp_extract_all({}, '\\w+|[^\\w\\s]'))"
_LENGTHS = (25, 50, 75, 90, 91, 92, 93, 94, 95, 96, 97, 98, 99)

ORACLE_SQL = {
    "script_profile": f"""WITH {fx.SCRIPTED}, c AS (SELECT doc_id, text, {', '.join(f"{c('text')} AS {s}" for s, c in _COUNT.items())} FROM scripted)
        SELECT doc_id, cjk, latin, hangul, kana, {_dominant('text')} AS dominant,
            CASE WHEN cjk + kana + hangul + latin = 0 THEN 'Chinese' WHEN cjk + kana + hangul > latin AND kana / (cjk + kana + hangul + latin)::DOUBLE > 0.05::DOUBLE THEN 'Japanese' WHEN cjk + kana + hangul > latin AND hangul / (cjk + kana + hangul + latin)::DOUBLE > 0.05::DOUBLE THEN 'Korean'
                WHEN cjk + kana + hangul > latin THEN 'Chinese' ELSE 'English' END AS language,
            regexp_matches(text, '^[\\x00-\\x7F]*$') AS ascii, regexp_matches(text, '[\\x{{4E00}}-\\x{{9FFF}}]') AS has_cjk FROM c""",
    "script_mismatch": f"WITH {fx.SCRIPTED}, d AS (SELECT {_dominant('x.text')} AS a, {_dominant('y.text')} AS b FROM scripted x JOIN scripted y ON x.doc_id = y.doc_id + 1) SELECT a, b, count(*) AS n FROM d WHERE a <> b AND a <> 'unknown' AND b <> 'unknown' GROUP BY ALL",
    "b64_run_filter": "WITH r AS (SELECT page_id, coalesce(list_max(list_transform(regexp_extract_all(html, '[A-Za-z0-9+/]+'), lambda x: length(x))), 0) AS run FROM pages) SELECT page_id, run::INTEGER AS run FROM r WHERE run < 1000",
    "search_topk_docs": f"""WITH {SEARCH}, s AS (SELECT page_id, title, {fx.strip('content')} AS content, {fx.strip('raw_content')} AS raw_content, page_id // 12 AS bucket, row_number() OVER (PARTITION BY page_id // 12 ORDER BY page_id) - 1 AS i FROM search),
        u AS (SELECT *, {_U('raw')} AS ur, {_U('title')} AS ut, content <> '' AS has, raw_content <> '' AND coalesce(list_max(list_transform(regexp_extract_all(raw_content, '[A-Za-z0-9+/]+'), lambda x: length(x))), 0) < 1000 AS usable FROM s),
        c AS (SELECT bucket, i, ut, {fx.strip('title')} AS title, CASE WHEN has AND usable THEN CASE WHEN ur < 1 - {1 / 11!r}::DOUBLE THEN content ELSE raw_content END WHEN has THEN content WHEN usable THEN raw_content END AS body FROM u),
        t AS (SELECT bucket, i, CASE WHEN title = '' OR ut < 0.5 THEN body WHEN ut < 0.75 THEN title || chr(10) || body ELSE 'title: ' || title || chr(10) || 'content: ' || body END AS doc FROM c),
        k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY bucket) AS n FROM t WHERE {fx.strip("coalesce(doc, '')")} <> ''),
        r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(concat('search|', bucket, '|', j, '|', doc))) AS k FROM k)
        SELECT bucket, count(*)::INTEGER AS n, sha256(string_agg(doc, chr(10) ORDER BY doc)) AS digest FROM r WHERE n <= 10 OR k <= 10 GROUP BY bucket""",
    "title_concat": f"WITH {SEARCH} SELECT page_id, sha256(CASE WHEN {fx.strip('title')} <> '' THEN {fx.strip('title')} || ' ' || content ELSE content END) AS digest FROM search",
    "token_truncate_discard": f"""WITH {PAIRS}, t AS (SELECT k, document, regexp_extract_all(document, '(\\s*(?:\\w+|[^\\w\\s]))', 1) AS p, len(regexp_extract_all(query, '\\w+|[^\\w\\s]')) AS q FROM pairs)
        SELECT k, len(p) > 20 AS was_cut, least(len(p), 20)::INTEGER AS n_tokens, sha256(CASE WHEN len(p) > 20 THEN array_to_string(p[1:20], '') ELSE document END) AS digest FROM t WHERE q + least(len(p), 20) <= 40""",
    "batch_ids_by_char_budget": """WITH RECURSIVE r AS (SELECT doc_id // 20 AS list, doc_id, greatest(n_chars // 3, 1) AS size, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS i FROM documents),
        g AS (SELECT list, i, doc_id, 0 AS batch, 1 AS n, 10 + size AS used FROM r WHERE i = 1 UNION ALL
            SELECT r.list, r.i, r.doc_id, CASE WHEN used + size > 5000 OR n >= 6 THEN batch + 1 ELSE batch END, CASE WHEN used + size > 5000 OR n >= 6 THEN 1 ELSE n + 1 END, CASE WHEN used + size > 5000 OR n >= 6 THEN 10 + size ELSE used + size END
            FROM g JOIN r ON r.list = g.list AND r.i = g.i + 1)
        SELECT doc_id, batch FROM g""",
    "profile_summary": "SELECT lang, count(n_chars) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, round(stddev_samp(n_chars), 6) AS sd FROM documents GROUP BY lang",
    "percentile_nearest": "WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, p, n_chars AS value FROM r, (VALUES (50), (90), (95), (99)) t(p) WHERE i = least(floor(n * p / 100), n - 1)",
    "percentile_linear": "SELECT lang, p, round(v, 6) AS value FROM (SELECT lang, unnest([50, 90, 95, 99]) AS p, unnest(quantile_cont(n_chars, [0.5, 0.9, 0.95, 0.99])) AS v FROM documents GROUP BY lang)",
    "freq_of_freq": f"WITH {PAIRS} SELECT 'query' AS what, size, count(*) AS n FROM (SELECT count(*) AS size FROM pairs GROUP BY query) GROUP BY ALL UNION ALL SELECT 'user', size, count(*) FROM (SELECT count(*) AS size FROM events GROUP BY user_id) GROUP BY ALL",
    "duplicate_pairs": "SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "score_vs_length": f"WITH {SCORED} SELECT floor(score / 0.1::DOUBLE)::INTEGER AS bucket, count(*) AS n, round(avg(n_chars), 6) AS mean, median(n_chars) AS median FROM scored GROUP BY 1",
    "topn_counter": "SELECT user_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY user_id ORDER BY n DESC, first LIMIT 15",
    "lang_cate_grouping_sets": "SELECT lang, source, count(*) AS n, grouping(lang, source)::INTEGER AS level FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))",
    "pair_reuse": f"WITH {PAIRS} SELECT count(*) AS n, count(DISTINCT query) AS n_one, count(DISTINCT document) AS n_two, round(count(*) / count(DISTINCT query)::DOUBLE, 6) AS per_one, round(count(*) / count(DISTINCT document)::DOUBLE, 6) AS per_two FROM pairs",
    "threshold_sweep": f"WITH {_CLASS}, {_SWEEP}",
    "threshold_sweep_exact": f"WITH {_CLASS.replace('scores AS', 'exact AS')}, scores AS (SELECT positive, floor(score * 100) / 100::DOUBLE AS score FROM exact), {_SWEEP}",
    "threshold_calibration": f"""WITH {_CLASS}, u AS (SELECT *, {h('calibrate', 'doc_id')} < 0.7::DOUBLE AS fitted FROM scores), f AS (SELECT * FROM u WHERE fitted), e AS (SELECT min(score) - 0.05::DOUBLE AS low, max(score) + 0.05::DOUBLE AS high FROM scores),
        {_curve('f', '(SELECT low FROM e)', '(SELECT high FROM e)', 2001)},
        c AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY i DESC) AS r FROM z, (VALUES (0.1::DOUBLE), (0.5), (0.9)) t(level) WHERE x1 IS NOT NULL AND sign(y - level) <> sign(y1 - level)),
        t AS (SELECT direction, level, x + (level - y) / (y1 - y) * (x1 - x) AS t FROM c JOIN (VALUES ('above', 0.9::DOUBLE), ('above', 0.5), ('below', 0.1), ('below', 0.5)) w(direction, level) USING (level) WHERE r = 1),
        n AS (SELECT direction, level, t, count(*) FILTER (CASE direction WHEN 'above' THEN score >= t ELSE score <= t END) AS hits, count(*) FILTER (positive = (direction = 'above') AND CASE direction WHEN 'above' THEN score >= t ELSE score <= t END) AS good, count(*) FILTER (positive = (direction = 'above')) AS every FROM t, u WHERE NOT fitted GROUP BY ALL)
        SELECT direction, level, round(t, 4) AS threshold, round(CASE WHEN hits > 0 THEN good / hits::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN every > 0 THEN good / every::DOUBLE ELSE 0 END, 6) AS recall, hits FROM n""",
    "threshold_summary": f"""WITH {_CLASS} SELECT positive, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(min(score), 6) AS least, round(max(score), 6) AS most,
        {', '.join(f'round(quantile_cont(score, {p / 100}), 6) AS p{p}' for p in (5, 10, 25, 50, 75, 90, 95))}, round(avg(CASE WHEN positive THEN score > 0.5 ELSE score < 0.5 END::INTEGER), 6) AS own_side FROM scores GROUP BY positive""",
    "search_provider_docs": f"""WITH {SEARCH}, s AS (SELECT page_id, title AS bare, page_id // 12 AS bucket, page_id // 12 % 4 AS way, {fx.strip('title')} AS title, {fx.strip('content')} AS content, CASE WHEN page_id // 12 % 4 = 0 THEN {fx.strip('raw_content')} ELSE '' END AS raw_content,
            row_number() OVER (PARTITION BY page_id // 12 ORDER BY page_id) - 1 AS i FROM search),
        u AS (SELECT *, {_U('raw')} AS ur, {_U('title')} AS ut, content <> '' AS has, raw_content <> '' AND coalesce(list_max(list_transform(regexp_extract_all(raw_content, '[A-Za-z0-9+/]+'), lambda x: length(x))), 0) < 1000 AS usable FROM s WHERE way < 3),
        c AS (SELECT bucket, i, ut, title, CASE WHEN has AND usable THEN CASE WHEN ur < 1 - {1 / 11!r}::DOUBLE THEN content ELSE raw_content END WHEN has THEN content WHEN usable THEN raw_content END AS body FROM u),
        t AS (SELECT bucket, i, CASE WHEN title = '' OR ut < 0.5 THEN body WHEN ut < 0.75 THEN title || chr(10) || body ELSE 'title: ' || title || chr(10) || 'content: ' || body END AS doc FROM c
            UNION ALL SELECT bucket, -1, {fx.strip("'A ' || bare")} FROM s WHERE bucket % 8 = 0 AND i = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY bucket) AS n FROM t WHERE {fx.strip("coalesce(doc, '')")} <> ''),
        r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(concat('search|', bucket, '|', j, '|', doc))) AS k FROM k)
        SELECT bucket, count(*)::INTEGER AS n, sha256(string_agg(doc, chr(10) ORDER BY doc)) AS digest FROM r WHERE n <= 10 OR k <= 10 GROUP BY bucket""",
    "unquoted_queries": "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'x' || doc_id WHEN 1 THEN 'x' || doc_id WHEN 2 THEN chr(34) || 'x' || doc_id WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN chr(39) || ' x' || doc_id || ' ' || chr(39) WHEN 6 THEN 'x' || doc_id ELSE chr(34) || ' none' || chr(39) END AS text FROM documents",
    "quota_errors": "SELECT doc_id, doc_id % 5 IN (0, 3) OR doc_id % 7 = 0 AS quota FROM documents",
    "length_sorted_batches": f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY coalesce(length(text), 0), {md5('length', 'doc_id')}, doc_id) - 1 AS position FROM documents) SELECT doc_id, position, position // 32 AS batch FROM r",
    "length_profile": f"""WITH {PAIRS}, s AS (SELECT 'query' AS field, {_TOKENS.format('query')} AS size FROM pairs UNION ALL SELECT 'document', {_TOKENS.format('document')} FROM pairs UNION ALL SELECT 'all', {_TOKENS.format('query')} FROM pairs UNION ALL SELECT 'all', {_TOKENS.format('document')} FROM pairs)
        SELECT field, count(*) AS n, min(size)::INTEGER AS least, max(size)::INTEGER AS most, round(avg(size), 6) AS mean, {', '.join(f'round(quantile_cont(size, {p / 100}), 6) AS p{p}' for p in _LENGTHS)} FROM s GROUP BY field""",
    "rank_weighted_means": "SELECT round(avg(value), 6) AS loss, 0::DOUBLE AS none FROM events",
    "kde_thresholds": f"""WITH {_CLASS}, b AS (SELECT positive, round(score / 1e-4::DOUBLE) * 1e-4::DOUBLE AS s, count(*) AS w FROM scores GROUP BY ALL),
        k AS (SELECT positive, count(*) AS n, pow(count(*)::DOUBLE, -0.2::DOUBLE) * stddev_samp(score) AS h FROM scores GROUP BY positive),
        g AS (SELECT i, -0.05::DOUBLE + i * (1.1::DOUBLE / 400) AS x FROM range(401) t(i)),
        d AS (SELECT i, x, sum(CASE WHEN positive THEN w * exp(-((x - s) / h) * ((x - s) / h) / 2) / (n * h * sqrt(2 * pi())) ELSE 0 END) AS p, sum(CASE WHEN NOT positive THEN w * exp(-((x - s) / h) * ((x - s) / h) / 2) / (n * h * sqrt(2 * pi())) ELSE 0 END) AS q FROM g, b JOIN k USING (positive) GROUP BY ALL),
        y AS (SELECT i, x, p * 0.125 / (p * 0.125 + q * 0.875) AS y FROM d WHERE p * 0.125 + q * 0.875 > 0),
        z AS (SELECT *, lead(x) OVER (ORDER BY i) AS x1, lead(y) OVER (ORDER BY i) AS y1 FROM y),
        c AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY i DESC) AS k FROM z, (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (0.9)) t(level) WHERE x1 IS NOT NULL AND sign(y - level) <> sign(y1 - level))
        SELECT level, round(x + (level - y) / (y1 - y) * (x1 - x), 3) AS threshold FROM c WHERE k = 1""",
    "numbered_list_parse": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'alpha,beta,' || CASE WHEN page_id % 2 = 0 THEN 'gamma' ELSE 'other' END || ',alpha' ELSE 'alpha,beta,' || CASE WHEN page_id % 2 = 0 THEN 'gamma' ELSE 'other' END || ',other' END AS labels FROM pages""",
    "rate_window_requests": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n_trailing FROM events",
    "rate_window_tokens": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW), 6) AS sum_trailing FROM events",
    "tumbling_events": "SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "session_events": """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_resume": "SELECT doc_id, lang FROM documents",
}
