"""Queries on annotations, predictions and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.metrics import revised
from ..operators import assemble, prediction, votes
from . import fixtures as fx
from .fixtures import ENRICHED, FIELDS, MAJORITY, MODELS, PREDICTIONS, VOTES, label_sql, r6

KEY = ["doc_id"]


def annotation_votes(spark, sf):
    return votes.counts(fx.votes(spark, sf), KEY)


def annotation_wide(spark, sf):
    return votes.wide(fx.votes(spark, sf), KEY, MODELS)


def majority_label(spark, sf):
    rows = votes.merged(fx.votes(spark, sf), KEY, MODELS)
    return rows.select("doc_id", "annotated_label", "yes_votes", "no_votes", r6("revised_score"))


def early_stop_pending(spark, sf):
    rows = fx.votes(spark, sf)
    return votes.pending(rows.select("doc_id").distinct(), rows.where("model_name in ('m0', 'm1', 'm2', 'm3')"), KEY, "m3")


def annotator_agreement(spark, sf):
    """How often each two annotators who both labelled a document agree."""
    rows = votes.wide(fx.votes(spark, sf), KEY, MODELS)
    both = [(a, b) for i, a in enumerate(MODELS) for b in MODELS[i + 1 :]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_annotated_label").alias("x"), F.col(f"{b}_annotated_label").alias("y")) for a, b in both]
    rows = rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("x is not null and y is not null")
    return rows.groupBy("a", "b").agg(F.round(F.avg((F.col("x") == F.col("y")).cast("double")), 6).alias("agreement"), F.count("*").alias("n"))


def loss_type_assign(spark, sf):
    rows = votes.merged(fx.votes(spark, sf), KEY, MODELS)
    return rows.select("doc_id", assemble.loss_type().alias("loss_type"))


def sft_target(spark, sf):
    rows = prediction.enriched(fx.predictions(spark, sf))
    return rows.select("doc_id", assemble.sft_target("annotated_label", "parsed_evidence").alias("target"))


def label_parse(spark, sf):
    from ..session import table

    return table(spark, sf, "conversations").select("conv_id", "turn", tx.first_token_label("text").alias("label"), tx.first_token_label(F.concat(F.lit(" NO.\n"), "text")).alias("forced"))


def tag_extract(spark, sf):
    return fx.predictions(spark, sf).select("doc_id", tx.tag_body("pred_text", "contribution").alias("contribution"), tx.tag_body("pred_text", "evidence").alias("evidence"), tx.without_tags("pred_text").alias("plain"))


def judge_scores_parse(spark, sf):
    rows = fx.predictions(spark, sf).withColumn("s", tx.judge_scores("judge_text"))
    return rows.select("doc_id", *[F.col(f"s.{f}").alias(f) for f in FIELDS])


def _routed(spark, sf):
    return prediction.routed(prediction.enriched(fx.predictions(spark, sf)))


def prediction_status(spark, sf):
    return _routed(spark, sf).select("doc_id", "pred_label", "label_match", "eval_status")


def confusion_prf(spark, sf):
    rows = prediction.confusion(prediction.enriched(fx.predictions(spark, sf)))
    return rows.select("tp", "fp", "fn", "tn", "unparseable", "n", r6("accuracy"), r6("precision_yes"), r6("recall_yes"), r6("f1_yes"))


def score_distribution(spark, sf):
    return prediction.score_table(_routed(spark, sf)).withColumn("mean", F.round("mean", 6))


def low_score_examples(spark, sf):
    return prediction.low_scores(_routed(spark, sf), "doc_id").select("doc_id", F.col("eval_scores.overall").alias("overall"))


def status_counts(spark, sf):
    return _routed(spark, sf).groupBy("eval_status").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (annotation_votes, annotation_wide, majority_label, early_stop_pending, annotator_agreement, loss_type_assign, sft_target, label_parse, tag_extract, judge_scores_parse, prediction_status, confusion_prf, score_distribution, low_score_examples, status_counts)}

_WIDE = ", ".join(f"arg_max({{annotated_label: annotated_label}}, ord) FILTER (model_name = '{m}') AS {m}" for m in MODELS)
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, x.annotated_label AS x, y.annotated_label AS y FROM votes x JOIN votes y USING (doc_id) WHERE x.model_name = '{a}' AND y.model_name = '{b}'" for i, a in enumerate(MODELS) for b in MODELS[i + 1 :])
_LOSS = "CASE WHEN (rs > 0.5 AND annotated_label = 'yes') OR (rs <= 0.5 AND annotated_label = 'no') THEN 'point-wise;sft' ELSE 'sft' END"
_ALL = " OR ".join(f"{f} IS NULL" for f in FIELDS)

ORACLE_SQL = {
    "annotation_votes": f"WITH {VOTES} SELECT doc_id, count(*) FILTER (annotated_label = 'yes') AS yes_votes, count(*) FILTER (annotated_label = 'no') AS no_votes FROM votes WHERE annotated_label IS NOT NULL GROUP BY doc_id",
    "annotation_wide": f"WITH {VOTES}, w AS (SELECT doc_id, {_WIDE} FROM votes GROUP BY doc_id) SELECT doc_id, {', '.join(f'{m}.annotated_label AS {m}_annotated_label' for m in MODELS)} FROM w",
    "majority_label": f"WITH {MAJORITY} SELECT doc_id, annotated_label, yes_votes, no_votes, round(pow(score, 1.609::DOUBLE), 6) AS revised_score FROM majority",
    "early_stop_pending": f"""WITH {VOTES}, v AS (SELECT * FROM votes WHERE model_name <> 'm4')
        SELECT doc_id FROM v GROUP BY doc_id HAVING count(*) FILTER (model_name = 'm3' AND annotated_label IS NOT NULL) = 0 AND count(*) FILTER (annotated_label = 'yes') < 3 AND count(*) FILTER (annotated_label = 'no') < 3""",
    "annotator_agreement": f"WITH {VOTES}, p AS ({_PAIRS}) SELECT a, b, round(avg((x = y)::INTEGER), 6) AS agreement, count(*) AS n FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL",
    "loss_type_assign": f"WITH {MAJORITY} SELECT doc_id, {_LOSS} AS loss_type FROM (SELECT *, pow(score, 1.609::DOUBLE) AS rs FROM majority)",
    "sft_target": f"WITH {ENRICHED} SELECT doc_id, {fx.strip('annotated_label || chr(10) || coalesce(parsed_evidence, ' + chr(39) * 2 + ')')} AS target FROM enriched",
    "label_parse": f"SELECT conv_id, turn, {label_sql('text')} AS label, {label_sql(chr(39) + ' NO.' + chr(39) + ' || chr(10) || text')} AS forced FROM conversations",
    "tag_extract": f"WITH {PREDICTIONS} SELECT doc_id, {fx.tag_sql('pred_text', 'contribution')} AS contribution, {fx.tag_sql('pred_text', 'evidence')} AS evidence, regexp_replace(pred_text, '</?(?:contribution|evidence)>', '', 'gi') AS plain FROM predictions",
    "judge_scores_parse": f"WITH {ENRICHED} SELECT doc_id, {', '.join(f'CASE WHEN NOT ({_ALL}) THEN {f} END AS {f}' for f in FIELDS)} FROM judged",
    "prediction_status": f"WITH {ENRICHED} SELECT doc_id, pred_label, label_match, eval_status FROM routed",
    "confusion_prf": f"""WITH {ENRICHED}, c AS (SELECT count(*) FILTER (annotated_label = 'yes' AND pred_label = 'yes') AS tp, count(*) FILTER (annotated_label = 'no' AND pred_label = 'yes') AS fp,
            count(*) FILTER (annotated_label = 'yes' AND pred_label = 'no') AS fn, count(*) FILTER (annotated_label = 'no' AND pred_label = 'no') AS tn, count(*) FILTER (pred_label IS NULL) AS unparseable, count(*) AS n FROM enriched),
        r AS (SELECT *, CASE WHEN n - unparseable <> 0 THEN (tp + tn) / (n - unparseable)::DOUBLE ELSE 0 END AS accuracy, CASE WHEN tp + fp <> 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn <> 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM c)
        SELECT tp, fp, fn, tn, unparseable, n, round(accuracy, 6) AS accuracy, round(p, 6) AS precision_yes, round(r, 6) AS recall_yes, round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1_yes FROM r""",
    "score_distribution": f"""WITH {ENRICHED}, u AS (UNPIVOT (SELECT {', '.join(FIELDS)} FROM routed WHERE eval_status = 'scored') ON {', '.join(FIELDS)} INTO NAME field VALUE v)
        SELECT field, round(avg(v), 6) AS mean, {', '.join(f'count(*) FILTER (v = {i}) AS n{i}' for i in range(1, 6))} FROM u GROUP BY field""",
    "low_score_examples": f"WITH {ENRICHED} SELECT doc_id, overall FROM routed WHERE eval_status = 'scored' AND overall <= 2 ORDER BY doc_id LIMIT 20",
    "status_counts": f"WITH {ENRICHED} SELECT eval_status, count(*) AS n FROM routed GROUP BY eval_status",
}
