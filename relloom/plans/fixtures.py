"""Inputs of the named queries, made from the driver's tables, each beside the SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash01
from ..operators import retrieval
from ..session import table


def h(seed: str, key: str) -> str:
    """SQL for ``hash01``."""
    return f"(('0x' || substr(md5(concat('{seed}|', {key})), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE)"


def md5(seed: str, key: str) -> str:
    """SQL for the hash order."""
    return f"md5(concat('{seed}|', {key}))"


def r6(x: str) -> Column:
    return F.round(F.col(x), 6).alias(x)


STRIP = r"'^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("score", hash01("s2", "doc_id"))


SCORED = f"scored AS (SELECT *, {h('s2', 'doc_id')} AS score FROM documents)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, k, query, document, score of each user turn and the assistant's next."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").selectExpr("conv_id", "turn", "concat(conv_id, '.', turn) k", "text query")
    answer = c.where("role = 'assistant'").selectExpr("conv_id", "turn - 1 turn", "text document")
    rows = user.join(answer, ["conv_id", "turn"])
    return rows.withColumn("score", (hash01("s2", "k") + hash01("s25", "k")) / 2)


PAIRS = f"""pairs AS (
    SELECT *, ({h('s2', 'k')} + {h('s25', 'k')}) / 2 AS score FROM (
        SELECT u.conv_id, u.turn, concat(u.conv_id, '.', u.turn) AS k, u.text AS query, a.text AS document
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'))"""


def found(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """query_id, vec_id, sim, rank of every tenth vector against all others."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 10 = 0").selectExpr("vec_id query_id", "embedding vector")
    return retrieval.top_k(queries, e.selectExpr("vec_id", "embedding vector"), k)


def labelled(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """``found`` with qlabel, label and relevance (1 where they agree)."""
    e = table(spark, sf_dir, "embeddings")
    rows = found(spark, sf_dir, k).join(e.selectExpr("vec_id query_id", "label qlabel"), "query_id").join(e.select("vec_id", "label"), "vec_id")
    return rows.withColumn("relevance", (F.col("qlabel") == F.col("label")).cast("int"))


FOUND = """sims AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, q.label AS qlabel, c.label AS label, (q.label = c.label)::INTEGER AS relevance,
        list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim
    FROM embeddings q JOIN embeddings c ON q.vec_id % 10 = 0 AND c.vec_id <> q.vec_id),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM sims)"""


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, model, query_id, pos, vec_id, score, relevance: the top 20 scored anew by two models; the second lacks three datasets."""
    rows = labelled(spark, sf_dir, 20).withColumn("key", F.concat_ws(".", F.col("query_id").cast("string"), F.col("vec_id").cast("string")))
    rows = rows.select(F.col("qlabel").alias("dataset"), "query_id", (F.col("rank") - 1).alias("pos"), "vec_id", "relevance", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), hash01(m, "key").alias("score")) for m in ("rr1", "rr2")])).alias("x"))
    return rows.select("dataset", "x.model", "query_id", "pos", "vec_id", "x.score", "relevance").where("model = 'rr1' or dataset < 7")


RERANK = FOUND + f""",
rerank AS (
    SELECT qlabel AS dataset, model, query_id, rank - 1 AS pos, vec_id, relevance,
        CASE model WHEN 'rr1' THEN {h('rr1', "concat(query_id, '.', vec_id)")} ELSE {h('rr2', "concat(query_id, '.', vec_id)")} END AS score
    FROM found, (VALUES ('rr1'), ('rr2')) m(model) WHERE rank <= 20 AND (model = 'rr1' OR qlabel < 7))"""

NDCG = """ordered AS (
    SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, pos) AS r, row_number() OVER (PARTITION BY model, query_id ORDER BY relevance DESC, pos) AS i FROM rerank),
ndcg AS (
    SELECT dataset, model, query_id, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg FROM (
        SELECT dataset, model, query_id, sum(CASE WHEN r <= 10 AND relevance > 0 THEN relevance / log2(r + 1) ELSE 0 END) AS dcg,
            sum(CASE WHEN i <= 10 AND relevance > 0 THEN relevance / log2(i + 1) ELSE 0 END) AS idcg
        FROM ordered GROUP BY ALL))"""

MODELS = [f"m{i}" for i in range(5)]


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, model_name, annotated_label, ord: five annotators who mostly agree with the quality label."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("m"))
    rows = rows.withColumn("u", hash01("v", F.concat_ws("|", F.col("doc_id").cast("string"), F.col("m").cast("string"))))
    says = F.when(F.col("u") < 0.85, F.col("quality")).otherwise(1 - F.col("quality"))
    label = F.when(F.col("u") >= 0.05, F.when(says == 1, "yes").otherwise("no"))
    return rows.select("doc_id", hash01("s2", "doc_id").alias("score"), F.concat(F.lit("m"), F.col("m").cast("string")).alias("model_name"), label.alias("annotated_label"), (F.col("doc_id") * 5 + F.col("m")).alias("ord"))


VOTES = f"""votes AS (
    SELECT doc_id, {h('s2', 'doc_id')} AS score, concat('m', m) AS model_name, doc_id * 5 + m AS ord,
        CASE WHEN u < 0.05 THEN NULL WHEN (CASE WHEN u < 0.85 THEN quality ELSE 1 - quality END) = 1 THEN 'yes' ELSE 'no' END AS annotated_label
    FROM (SELECT doc_id, quality, m, {h('v', "concat(doc_id, '|', m)")} AS u FROM labels, range(5) t(m)))"""

MAJORITY = VOTES + """,
majority AS (
    SELECT doc_id, score, CASE WHEN y > n THEN 'yes' ELSE 'no' END AS annotated_label, y AS yes_votes, n AS no_votes FROM (
        SELECT doc_id, any_value(score) AS score, count(*) FILTER (annotated_label = 'yes') AS y, count(*) FILTER (annotated_label = 'no') AS n FROM votes GROUP BY doc_id)
    WHERE y > 2 OR n > 2)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, annotated_label, pred_text, judge_text made from hashes."""
    from ..operators.votes import majority, wide

    rows = majority(wide(votes(spark, sf_dir), ["doc_id"], MODELS), MODELS).select("doc_id", "annotated_label")
    u, w, j = hash01("p", "doc_id"), hash01("w", "doc_id"), hash01("j", "doc_id")
    first = F.when(u < 0.45, "Yes, ").when(u < 0.85, " no. ").otherwise("maybe ")
    parts = F.when(w < 0.7, F.concat(F.lit("<contribution> c"), F.col("doc_id").cast("string"), F.lit("\n</contribution><evidence>e "), F.col("doc_id").cast("string"), F.lit(" </evidence>"))).when(w < 0.9, "<contribution> </contribution>").otherwise("")
    scores = [F.concat(F.lit(f"<{f}>"), (F.floor(hash01(f"f{i}", "doc_id") * 5) + 1).cast("string"), F.lit(f"</{f}>")) for i, f in enumerate(FIELDS)]
    judge = F.concat(F.lit("<scores>"), *scores[:-1], F.when(j < 0.9, scores[-1]).otherwise(""), F.lit("</scores><reason>r</reason>"))
    return rows.select("doc_id", "annotated_label", F.concat(first, parts).alias("pred_text"), judge.alias("judge_text"))


FIELDS = ("contribution_accuracy", "contribution_coverage", "evidence_faithfulness", "evidence_self_contained", "evidence_concision", "overall")
_SCORES = [f"'<{f}>' || (floor({h(f'f{i}', 'doc_id')} * 5) + 1)::BIGINT || '</{f}>'" for i, f in enumerate(FIELDS)]
PREDICTIONS = MAJORITY + f""",
predictions AS (
    SELECT doc_id, annotated_label,
        CASE WHEN u < 0.45 THEN 'Yes, ' WHEN u < 0.85 THEN ' no. ' ELSE 'maybe ' END ||
        CASE WHEN w < 0.7 THEN '<contribution> c' || doc_id || chr(10) || '</contribution><evidence>e ' || doc_id || ' </evidence>' WHEN w < 0.9 THEN '<contribution> </contribution>' ELSE '' END AS pred_text,
        '<scores>' || {' || '.join(_SCORES[:-1])} || CASE WHEN j < 0.9 THEN {_SCORES[-1]} ELSE '' END || '</scores><reason>r</reason>' AS judge_text
    FROM (SELECT *, {h('p', 'doc_id')} AS u, {h('w', 'doc_id')} AS w, {h('j', 'doc_id')} AS j FROM majority))"""


def label_sql(x: str) -> str:
    """SQL for the first-token label."""
    token = f"regexp_replace(lower(regexp_extract({strip(x)}, '^(\\S+)', 1)), '[.,;:!?]+$', '')"
    return f"CASE WHEN {token} IN ('yes', 'no') THEN {token} END"


def tag_sql(x: str, tag: str) -> str:
    return f"nullif({strip(f'''regexp_extract({x}, '(?s)<{tag}>(.*?)</{tag}>', 1)''')}, '')"


def judge_sql(x: str, field: str) -> str:
    return f"nullif(regexp_extract(regexp_extract({x}, '(?s)<scores>(.*?)</scores>', 1), '<{field}>\\s*([1-5])\\s*</{field}>', 1), '')::INTEGER"


ENRICHED = PREDICTIONS + f""",
parsed AS (
    SELECT *, {label_sql('pred_text')} AS pred_label, {tag_sql('pred_text', 'contribution')} AS c, {tag_sql('pred_text', 'evidence')} AS e FROM predictions),
enriched AS (
    SELECT doc_id, annotated_label, pred_text, judge_text, pred_label, CASE WHEN pred_label IS NOT DISTINCT FROM annotated_label THEN 'yes' ELSE 'no' END AS label_match,
        CASE WHEN pred_label = 'yes' THEN c END AS parsed_contribution, CASE WHEN pred_label = 'yes' THEN e END AS parsed_evidence FROM parsed),
judged AS (SELECT *, {', '.join(f'{judge_sql("judge_text", f)} AS {f}' for f in FIELDS)} FROM enriched),
routed AS (
    SELECT *, CASE WHEN NOT (pred_label IS NOT DISTINCT FROM 'yes' AND annotated_label IS NOT DISTINCT FROM 'yes') THEN 'skipped_not_yesyes'
        WHEN parsed_contribution IS NULL OR parsed_evidence IS NULL THEN 'skipped_no_parse'
        WHEN {' OR '.join(f'{f} IS NULL' for f in FIELDS)} THEN 'failed' ELSE 'scored' END AS eval_status FROM judged)"""


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, title, content, raw_content."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", "url", title.alias("title"), F.regexp_replace("html", r"<[^>]*>", "").alias("content"), F.col("html").alias("raw_content"))


SEARCH = """search AS (
    SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_replace(html, '<[^>]*>', '', 'g') AS content, html AS raw_content FROM pages)"""


def scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: whole texts, and beside them others of mixed scripts, on both sides of the rules' bounds."""
    n, text = F.col("n_chars").cast("int"), F.coalesce(F.col("text"), F.lit(""))
    some = lambda c, k: F.repeat(F.lit(c), k)
    kinds = [text, F.concat(text, some("\u6f22", n)), F.concat(some("\u6f22", F.lit(95)), some("\u304b", F.col("doc_id").cast("int") % 10)), F.concat(some("\ud55c", n % 80), some("\u6f22", F.lit(60)), some("x", F.lit(50))), F.lit("12 34 \u0416\u0436"), F.lit(" "), F.concat(some("\u00e9\u00fc\u00f1", n), some("\u6f22", F.lit(1))), F.concat(some("\u304b", F.lit(4)), some("\u6f22", F.lit(60)), some("y", F.lit(50)))]
    found = text
    for k, x in enumerate(kinds):
        found = F.when(F.col("doc_id") % len(kinds) == k, x).otherwise(found)
    return documents(spark, sf_dir).select("doc_id", found.alias("text"))


SCRIPTED = """scripted AS (
    SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN coalesce(text, '') || repeat('\u6f22', n_chars) WHEN 2 THEN repeat('\u6f22', 95) || repeat('\u304b', doc_id % 10)
        WHEN 3 THEN repeat('\ud55c', n_chars % 80) || repeat('\u6f22', 60) || repeat('x', 50) WHEN 4 THEN '12 34 \u0416\u0436' WHEN 5 THEN ' '
        WHEN 6 THEN repeat('\u00e9\u00fc\u00f1', n_chars) || '\u6f22' ELSE repeat('\u304b', 4) || repeat('\u6f22', 60) || repeat('y', 50) END AS text FROM documents)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket, extra: pages in dozens as one of three providers' responses; some have an answer, some no list of results."""
    rows = search(spark, sf_dir).withColumn("bucket", (F.col("page_id") / 12).cast("long"))
    kind = "array<struct<page_id:bigint,title:string,content:string,raw_content:string>>"
    lists = rows.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("page_id", "title", "content", "raw_content"))).cast(kind).alias("x"))
    way, x = F.col("bucket") % 4, F.col("x")
    of = lambda *names: F.transform(x, lambda r: F.struct(*[r[a].alias(b) for a, b in names]))
    first = F.when(F.col("bucket") % 8 == 0, F.concat(F.lit(" A "), F.get(x, F.lit(0))["title"], F.lit(" "))).otherwise(F.lit(" "))
    tavily = F.struct(first.alias("answer"), of(("title", "title"), ("content", "content"), ("raw_content", "raw_content")).alias("results"))
    exa = F.struct(F.when(way == 2, of(("title", "title"), ("content", "text"))).alias("results"))
    zhipu = of(("title", "title"), ("content", "content"))
    return lists.select("bucket", F.struct(F.when(way == 0, tavily).alias("original_tavily_result"), F.when(way == 1, zhipu).alias("original_zhipu_result"), F.when(way >= 2, exa).alias("original_exa_result")).alias("extra"))
