"""Quality of predictions: parsed labels and parts, who is judged, confusion and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.metrics import guarded, matches


def enriched(df: DataFrame, text: str = "pred_text", label: str = "annotated_label") -> DataFrame:
    """pred_label, label_match and, where the prediction is yes, the parsed parts."""
    df = df.withColumn("pred_label", tx.first_token_label(text)).withColumn("label_match", matches("pred_label", label))
    yes = F.col("pred_label") == "yes"
    return df.withColumn("parsed_contribution", F.when(yes, tx.tag_body(text, "contribution"))).withColumn("parsed_evidence", F.when(yes, tx.tag_body(text, "evidence")))


def eligible(label: str = "annotated_label"):
    """True where the judge is asked: both labels yes and both parts there."""
    return (F.col("pred_label").eqNullSafe("yes") & F.col(label).eqNullSafe("yes")) & F.col("parsed_contribution").isNotNull() & F.col("parsed_evidence").isNotNull()


def routed(df: DataFrame, judged: str = "judge_text", label: str = "annotated_label") -> DataFrame:
    """eval_status and eval_scores: scored, skipped_no_parse, skipped_not_yesyes or failed."""
    both = F.col("pred_label").eqNullSafe("yes") & F.col(label).eqNullSafe("yes")
    df = df.withColumn("eval_scores", F.when(eligible(label), tx.judge_scores(judged)))
    status = F.when(~both, "skipped_not_yesyes").when(~eligible(label), "skipped_no_parse").when(F.col("eval_scores").isNull(), "failed").otherwise("scored")
    return df.withColumn("eval_status", status)


def confusion(df: DataFrame, label: str = "annotated_label") -> DataFrame:
    """One row: the four cells, unparseable predictions, and guarded accuracy, precision, recall, F1."""
    cell = lambda t, p: F.count_if((F.col(label) == t) & (F.col("pred_label") == p))
    n = df.agg(cell("yes", "yes").alias("tp"), cell("no", "yes").alias("fp"), cell("yes", "no").alias("fn"), cell("no", "no").alias("tn"), F.count_if(F.col("pred_label").isNull()).alias("unparseable"), F.count("*").alias("n"))
    n = n.withColumn("accuracy", guarded(F.col("tp") + F.col("tn"), F.col("n") - F.col("unparseable")))
    n = n.withColumn("precision_yes", guarded(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall_yes", guarded(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1_yes", guarded(2 * F.col("precision_yes") * F.col("recall_yes"), F.col("precision_yes") + F.col("recall_yes")))


def score_table(df: DataFrame, fields: tuple[str, ...] = tx.SCORE_FIELDS) -> DataFrame:
    """field, mean, n1..n5 over scored rows."""
    scored = df.where(F.col("eval_status") == "scored")
    rows = scored.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"eval_scores.{f}").alias("v")) for f in fields])).alias("x")).select("x.*")
    return rows.groupBy("field").agg(F.avg("v").alias("mean"), *[F.count_if(F.col("v") == i).alias(f"n{i}") for i in range(1, 6)])


def low_scores(df: DataFrame, order: str, most: int = 2, n: int = 20) -> DataFrame:
    """The first ``n`` scored rows whose overall score is at most ``most``."""
    rows = df.where((F.col("eval_status") == "scored") & (F.coalesce(F.col("eval_scores.overall"), F.lit(5)) <= most))
    return rows.orderBy(order).limit(n)
