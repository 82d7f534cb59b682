"""Queries on scores, sampling, splits and mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import hash01, row_key, pair_key, short_key
from ..functions.metrics import revised
from ..operators import assemble, pairs, profile, sampling, votes
from ..session import table
from . import fixtures as fx
from .fixtures import PAIRS, SCORED, h, md5, r6


def revised_score(spark, sf):
    return fx.scored(spark, sf).select("doc_id", F.round(revised("score"), 6).alias("revised_score"))


def score_histogram(spark, sf):
    return profile.histogram(fx.scored(spark, sf), "score", 0.05)


def balanced_bucket_sample(spark, sf):
    return sampling.balanced_buckets(fx.scored(spark, sf), "score", "doc_id").select("doc_id", "bucket", r6("score"))


def source_ratio_sample(spark, sf):
    rows = fx.scored(spark, sf).withColumn("kind", F.when(F.col("source").isin("src1", "src2", "src3", "src4"), "posneg").otherwise("web"))
    return sampling.at_ratio(rows, "kind", "posneg", "web", "doc_id").select("doc_id", "kind")


def per_source_cap(spark, sf):
    return sampling.first_of_groups(fx.documents(spark, sf), ["source"], "doc_id", "cap", 30).select("doc_id", "source")


def per_source_cap_nulls(spark, sf):
    """Rows without a source are a group with a cap of its own."""
    rows = fx.documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"))
    return sampling.first_of_groups(rows, ["source"], "doc_id", "cap", 30)


def category_balance(spark, sf):
    rows = fx.documents(spark, sf).selectExpr("doc_id", "lang", "concat(source, '-', cast(floor(n_chars / 4000) as string)) cate")
    return sampling.balanced_categories(rows, "lang", "cate", "doc_id", ("en", "de")).select("doc_id", "lang", "cate")


def train_dev_split(spark, sf):
    train, dev = sampling.split_queries(fx.pairs(spark, sf), "query", 25, "dev")
    return train.selectExpr("k", "'train' part").union(dev.selectExpr("k", "'dev' part"))


def bernoulli_select(spark, sf):
    rows = sampling.bernoulli(fx.pairs(spark, sf), "k", 0.4, "sel")
    return rows.where(F.size(tx.words("query")) <= 40).select("k")


def interleave_plan(spark, sf):
    n = table(spark, sf, "conversations").agg(F.count_if(F.col("role") == "user").alias("sft"), F.count_if(F.col("role") != "user").alias("point")).first()
    return sampling.interleaved(spark, n["point"], n["sft"], 0.3).select("pos", "use_sft", "local")


def resume_antijoin(spark, sf):
    rows = fx.documents(spark, sf).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    return votes.unfinished(rows, rows.where("doc_id % 3 = 0"), "key").select("doc_id", "key")


def heldout_pairs(spark, sf):
    rows = fx.pairs(spark, sf)
    return assemble.heldout(rows, rows.where("conv_id % 2 = 0"), "query", 100, "held", "k").select("k")


def keywords_attach(spark, sf):
    rows = fx.pairs(spark, sf)
    lookup = rows.where("conv_id % 3 <> 0").select("query", F.concat(F.lit("kw "), "k").alias("keywords"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return pairs.with_last(rows.select("k", "query"), lookup, "query", "keywords", "ord").select("k", "keywords")


def substring_exclusion(spark, sf):
    return pairs.without_markers(fx.documents(spark, sf), "text", ["License", "###"]).select("doc_id")


def quality_gate(spark, sf):
    """One positive and some negatives with two teachers' scores for each document."""
    rows = fx.documents(spark, sf).where("doc_id is not null")
    many = F.when(F.col("doc_id") % 5 == 0, 6).otherwise(7)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), many)))
    rows = rows.withColumn("k", F.concat_ws(".", F.col("doc_id").cast("string"), F.col("i").cast("string")))
    up = lambda seed: F.when(F.col("i") == 0, 0.45 + 0.55 * hash01(seed, "k")).otherwise(0.7 * hash01(seed, "k"))
    rows = rows.select("doc_id", "i", up("s2").alias("a"), up("s25").alias("b"))
    at = lambda c, one: F.array_sort(F.collect_list(F.when((F.col("i") == 0) == one, F.struct("i", c))))
    lists = rows.groupBy("doc_id").agg(at("a", True).alias("pa"), at("a", False).alias("na"), at("b", True).alias("pb"), at("b", False).alias("nb"))
    lists = lists.select("doc_id", *[F.col(f"{c}.{c[1]}").alias(c) for c in ("pa", "na", "pb", "nb")])
    return lists.where(pairs.teacher_gate([F.col("pa"), F.col("pb")], [F.col("na"), F.col("nb")])).select("doc_id")


def row_hashes(spark, sf):
    return fx.pairs(spark, sf).select("k", pair_key().alias("pair_hash"), short_key("query").alias("query_hash"), F.sha2(F.concat_ws("\n", "query", "document", F.lit("m1")).cast("binary"), 256).alias("model_hash"))


def duplicate_rows(spark, sf):
    """Rows of equal content by the canonical row key."""
    return profile.duplicates(fx.documents(spark, sf).select(row_key("text", "lang").alias("key"), "doc_id"), ["key"]).agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("extra"), F.max("n").alias("most"))


def prompt_render(spark, sf):
    text = tx.rendered("Query: {{ query }}\nDocument: {{ document }}\nAnswer:", query=F.col("query"), document=F.col("document"))
    return fx.pairs(spark, sf).select("k", F.sha2(text.cast("binary"), 256).alias("prompt"))


def key_allocation(spark, sf):
    return sampling.allocated(table(spark, sf, "events").select("event_id"), "event_id", 7, 1000).select("event_id", "slot")


def final_assembly(spark, sf):
    """Two corpora's evidence rows and distilled pairs to three sets: rows by set, loss type and query."""
    rows = fx.pairs(spark, sf)
    both = F.concat_ws("\n", "query", "document")
    evidence = rows.select("conv_id", "query", "document", revised(hash01("es", both)).alias("revised_score"), F.when(hash01("ev", both) < 0.5, "yes").otherwise("no").alias("annotated_label"))
    distilled = rows.select("conv_id", "query", "document", "score")
    # the corpora's shares differ, so the larger dev set is cut
    parts = [(evidence.where(f"conv_id % 5 in {e}").drop("conv_id"), distilled.where(f"conv_id % 5 = {d}").drop("conv_id")) for e, d in (("(0, 1)", 2), ("(3)", 4))]
    sets = assemble.final_sets(parts, 40)
    every = [df.select(F.lit(name).alias("part"), "loss_type", "query", F.round("revised_score", 6).alias("revised_score")) for name, df in sets.items()]
    return every[0].union(every[1]).union(every[2])


QUERIES = {f.__name__: f for f in (revised_score, score_histogram, balanced_bucket_sample, source_ratio_sample, per_source_cap, per_source_cap_nulls, category_balance, train_dev_split, bernoulli_select, interleave_plan, resume_antijoin, heldout_pairs, keywords_attach, substring_exclusion, quality_gate, row_hashes, duplicate_rows, prompt_render, key_allocation, final_assembly)}

_FIRST = lambda seed, key, by: f"row_number() OVER (PARTITION BY {by} ORDER BY {md5(seed, key)}, {key})"

ORACLE_SQL = {
    "revised_score": f"WITH {SCORED} SELECT doc_id, round(pow(score, 1.609::DOUBLE), 6) AS revised_score FROM scored",
    "score_histogram": f"WITH {SCORED}, c AS (SELECT floor(score / 0.05::DOUBLE)::INTEGER AS bucket, count(*) AS n FROM scored GROUP BY 1) SELECT bucket, n, floor(n::DOUBLE / (SELECT max(n) FROM c) * 50)::INTEGER AS bar FROM c",
    "balanced_bucket_sample": f"""WITH {SCORED}, b AS (SELECT *, floor(score / 0.05::DOUBLE)::INTEGER AS bucket FROM scored),
        sizes AS (SELECT bucket, count(*) AS n, CASE WHEN bucket * 0.05::DOUBLE >= 0.65::DOUBLE THEN 1.7::DOUBLE ELSE 1::DOUBLE END AS times FROM b GROUP BY bucket HAVING bucket * 0.05::DOUBLE >= 0.2::DOUBLE AND bucket * 0.05::DOUBLE < 0.95::DOUBLE),
        caps AS (SELECT bucket, floor((SELECT floor(min(n / times) / 0.8::DOUBLE) FROM sizes) * times) AS cap FROM sizes),
        r AS (SELECT *, {_FIRST('bal', 'doc_id', 'bucket')} AS k FROM b)
        SELECT doc_id, bucket, round(score, 6) AS score FROM r LEFT JOIN caps USING (bucket) WHERE cap IS NULL OR k <= cap""",
    "source_ratio_sample": f"""WITH t AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src2', 'src3', 'src4') THEN 'posneg' ELSE 'web' END AS kind FROM documents),
        n AS (SELECT count(*) FILTER (kind = 'posneg') AS n1, count(*) FILTER (kind = 'web') AS n2 FROM t),
        m AS (SELECT *, floor(n1 * 1.5::DOUBLE) AS m2, floor(n2 / 1.5::DOUBLE) AS m1 FROM n),
        w AS (SELECT *, m2 <= n2 AND (NOT m1 <= n1 OR n1 + m2 >= m1 + n2) AS cut2 FROM m),
        r AS (SELECT *, {_FIRST('ratio', 'doc_id', 'kind')} AS k FROM t)
        SELECT doc_id, kind FROM r, w WHERE k <= CASE WHEN kind = 'posneg' THEN CASE WHEN NOT cut2 AND m1 <= n1 THEN m1 ELSE n1 END ELSE CASE WHEN cut2 THEN m2 ELSE n2 END END""",
    "per_source_cap": f"SELECT doc_id, source FROM (SELECT *, {_FIRST('cap', 'doc_id', 'source')} AS k FROM documents) WHERE k <= 30",
    "per_source_cap_nulls": f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS source FROM documents) SELECT doc_id, source FROM (SELECT *, {_FIRST('cap', 'doc_id', 'source')} AS k FROM t) WHERE k <= 30",
    "category_balance": f"""WITH t AS (SELECT doc_id, lang, concat(source, '-', floor(n_chars / 4000)::BIGINT) AS cate FROM documents WHERE lang IN ('en', 'de')),
        s AS (SELECT lang, cate, count(*) AS n FROM t GROUP BY ALL),
        p AS (SELECT lang, quantile_cont(n, 0.1) AS rare FROM s GROUP BY lang),
        q AS (SELECT lang, floor(median(n)) AS target FROM s JOIN p USING (lang) WHERE n > rare GROUP BY lang),
        k AS (SELECT lang, cate, n, CASE WHEN n <= rare THEN n ELSE greatest(least(n, floor(target * (1 - 0.1)::DOUBLE)), least(n, floor(target * (1 + 0.1)::DOUBLE))) END::BIGINT AS take FROM s JOIN p USING (lang) LEFT JOIN q USING (lang)),
        g AS (SELECT sum(take) FILTER (lang = 'en') AS a, sum(take) FILTER (lang = 'de') AS b FROM k),
        f AS (SELECT a, b, CASE WHEN floor(a * 3 / 7) > b THEN floor(b * 7 / 3) ELSE a END AS ga, least(floor(a * 3 / 7), b) AS gb FROM g),
        c AS (SELECT lang, cate, take, sum(take) OVER (PARTITION BY lang ORDER BY cate) AS upto, CASE lang WHEN 'en' THEN a ELSE b END AS pool, CASE lang WHEN 'en' THEN ga ELSE gb END AS goal FROM k, f),
        d AS (SELECT lang, cate, CASE WHEN pool <= goal THEN take ELSE floor(upto * (goal::DOUBLE / pool) + 1e-9) - floor((upto - take) * (goal::DOUBLE / pool) + 1e-9) END AS cap FROM c),
        r AS (SELECT *, {_FIRST('cate', 'doc_id', 'lang, cate')} AS i FROM t)
        SELECT doc_id, lang, cate FROM r JOIN d USING (lang, cate) WHERE i <= cap""",
    "train_dev_split": f"WITH {PAIRS}, q AS (SELECT DISTINCT query FROM pairs), dev AS (SELECT query FROM q ORDER BY {md5('dev', 'query')}, query LIMIT 25) SELECT k, CASE WHEN query IN (SELECT query FROM dev) THEN 'dev' ELSE 'train' END AS part FROM pairs",
    "bernoulli_select": f"WITH {PAIRS} SELECT k FROM pairs WHERE {h('sel', 'k')} < 0.4::DOUBLE AND len(list_filter(regexp_split_to_array(query, '[\\s\\x{{00A0}}\\x{{3000}}]+'), lambda x: x <> '')) <= 40",
    "interleave_plan": f"""WITH n AS (SELECT count(*) FILTER (role = 'user') AS sft, count(*) FILTER (role <> 'user') AS point FROM conversations),
        l AS (SELECT greatest(ceil(point / (1 - 0.3)::DOUBLE), ceil(sft / 0.3::DOUBLE))::BIGINT AS size, sft, point FROM n),
        p AS (SELECT pos, {h('mix', 'pos')} < 0.3::DOUBLE AS use_sft, sft, point FROM l, LATERAL (SELECT unnest(range(size)) AS pos))
        SELECT pos, use_sft, (row_number() OVER (PARTITION BY use_sft ORDER BY pos) - 1) % CASE WHEN use_sft THEN sft ELSE point END AS local FROM p""",
    "resume_antijoin": "WITH t AS (SELECT doc_id, sha256(text) AS key FROM documents) SELECT doc_id, key FROM t WHERE key NOT IN (SELECT key FROM t WHERE doc_id % 3 = 0)",
    "heldout_pairs": f"WITH {PAIRS} SELECT k FROM pairs WHERE query NOT IN (SELECT query FROM pairs WHERE conv_id % 2 = 0) ORDER BY {md5('held', 'query')}, query, k LIMIT 100",
    "keywords_attach": f"WITH {PAIRS}, l AS (SELECT query, arg_max('kw ' || k, conv_id * 1000 + turn) AS keywords FROM pairs WHERE conv_id % 3 <> 0 GROUP BY query) SELECT k, keywords FROM pairs LEFT JOIN l USING (query)",
    "substring_exclusion": "SELECT doc_id FROM documents WHERE NOT contains(text, 'License') AND NOT contains(text, '###')",
    "quality_gate": f"""WITH t AS (SELECT doc_id, unnest(range(0, CASE WHEN doc_id % 5 = 0 THEN 7 ELSE 8 END)) AS i FROM documents),
        s AS (SELECT doc_id, i, CASE WHEN i = 0 THEN 0.45::DOUBLE + 0.55::DOUBLE * {h('s2', "concat(doc_id, '.', i)")} ELSE 0.7::DOUBLE * {h('s2', "concat(doc_id, '.', i)")} END AS a,
            CASE WHEN i = 0 THEN 0.45::DOUBLE + 0.55::DOUBLE * {h('s25', "concat(doc_id, '.', i)")} ELSE 0.7::DOUBLE * {h('s25', "concat(doc_id, '.', i)")} END AS b FROM t)
        SELECT doc_id FROM s GROUP BY doc_id HAVING count(*) FILTER (i > 0) = 7 AND min(a) FILTER (i = 0) >= 0.5 AND min(b) FILTER (i = 0) >= 0.5 AND min((a + b) / 2) FILTER (i = 0) >= 0.5
            AND min(a) FILTER (i = 0) >= max(a) FILTER (i > 0) AND min(b) FILTER (i = 0) >= max(b) FILTER (i > 0) AND min((a + b) / 2) FILTER (i = 0) >= max((a + b) / 2) FILTER (i > 0)""",
    "row_hashes": f"WITH {PAIRS} SELECT k, sha256(concat(query, chr(10), document)) AS pair_hash, substr(sha256(query), 1, 16) AS query_hash, sha256(concat(query, chr(10), document, chr(10), 'm1')) AS model_hash FROM pairs",
    "duplicate_rows": "WITH c AS (SELECT text, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1) SELECT count(*) AS groups, sum(n - 1)::BIGINT AS extra, max(n) AS most FROM c",
    "prompt_render": f"WITH {PAIRS} SELECT k, sha256(concat('Query: ', query, chr(10), 'Document: ', document, chr(10), 'Answer:')) AS prompt FROM pairs",
    "key_allocation": "SELECT event_id, CASE WHEN event_id // 7 < 1000 THEN event_id % 7 END AS slot FROM events",
    "final_assembly": f"""WITH {PAIRS}, p AS (SELECT *, concat(query, chr(10), document) AS pair, CASE WHEN conv_id % 5 <= 2 THEN 0 ELSE 1 END AS corpus, conv_id % 5 IN (0, 1, 3) AS is_evidence FROM pairs),
        e AS (SELECT corpus, query, pair, pow({h('es', 'pair')}, 1.609::DOUBLE) AS rs, CASE WHEN {h('ev', 'pair')} < 0.5 THEN 'yes' ELSE 'no' END AS label FROM p WHERE is_evidence),
        l AS (SELECT *, CASE WHEN (rs > 0.5 AND label = 'yes') OR (rs <= 0.5 AND label = 'no') THEN 'point-wise;sft' ELSE 'sft' END AS loss_type FROM e),
        q AS (SELECT corpus, query, row_number() OVER (PARTITION BY corpus ORDER BY CASE corpus WHEN 0 THEN {md5('final0', 'query')} ELSE {md5('final1', 'query')} END, query) AS i FROM (SELECT DISTINCT corpus, query FROM l)),
        m AS (SELECT l.*, i <= 40 AS is_dev FROM l JOIN q ON q.corpus = l.corpus AND q.query = l.query),
        cap AS (SELECT least(count(*) FILTER (corpus = 0), count(*) FILTER (corpus = 1)) AS cap FROM m WHERE is_dev),
        d AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY {md5('final', 'pair')}, pair) AS k2 FROM m WHERE is_dev)
        SELECT 'sft' AS part, loss_type, query, round(rs, 6) AS revised_score FROM m WHERE NOT is_dev
        UNION ALL SELECT 'point_wise', 'point-wise', query, round(pow(score, 1.609::DOUBLE), 6) FROM p WHERE NOT is_evidence
        UNION ALL SELECT 'dev', loss_type, query, round(rs, 6) FROM d, cap WHERE k2 <= cap""",
}
