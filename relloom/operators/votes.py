"""Annotator labels: long to wide, votes, majorities and what is still to be annotated.

``annotations``: query, document, score, model_name, annotated_label ('yes', 'no' or null), ord (position in the log).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import revised

NEEDED = 3


def wide(annotations: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """One row for each pair with a label column for each model; a later row overwrites, even with null."""
    last = annotations.groupBy(*keys, "model_name").agg(F.max_by("annotated_label", "ord").alias("label"))
    return last.groupBy(*keys).pivot("model_name", models).agg(F.first("label")).withColumnsRenamed({m: f"{m}_annotated_label" for m in models})


def base_fields(annotations: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """First-written fields of each pair; a field first missing is filled by the first row that has it."""
    first = [F.min_by(F.struct(f), F.when(F.col(f).isNotNull(), F.col("ord")))[f].alias(f) for f in fields]
    return annotations.groupBy(*keys).agg(*first)


def majority(wide_rows: DataFrame, models: list[str], most: int = 2) -> DataFrame:
    """Rows where more than ``most`` annotators say yes or no, with their ``annotated_label``."""
    columns = [F.col(f"`{m}_annotated_label`") for m in models]
    yes = sum((F.when(c == "yes", 1).otherwise(0) for c in columns), F.lit(0))
    no = sum((F.when(c == "no", 1).otherwise(0) for c in columns), F.lit(0))
    rows = wide_rows.withColumn("yes_votes", yes).withColumn("no_votes", no)
    return rows.where((F.col("yes_votes") > most) | (F.col("no_votes") > most)).withColumn("annotated_label", F.when(F.col("yes_votes") > F.col("no_votes"), "yes").otherwise("no"))


def merged(annotations: DataFrame, keys: list[str], models: list[str], score: str = "score") -> DataFrame:
    """The wide table with majority labels and the revised score."""
    base = base_fields(annotations, keys, [score])
    return majority(wide(annotations, keys, models), models).join(base, keys).withColumn("revised_score", revised(score))


def counts(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """yes_votes and no_votes of each pair; the first row of each annotator counts."""
    first = annotations.where(F.col("annotated_label").isin("yes", "no")).groupBy(*keys, "model_name").agg(F.min_by("annotated_label", "ord").alias("label"))
    return first.groupBy(*keys).agg(F.count_if(F.col("label") == "yes").alias("yes_votes"), F.count_if(F.col("label") == "no").alias("no_votes"))


def pending(pairs: DataFrame, annotations: DataFrame, keys: list[str], model: str, needed: int = NEEDED) -> DataFrame:
    """Pairs that a model hasn't labelled (null labels are tried again) and that no label has ``needed`` votes for."""
    done = annotations.where((F.col("model_name") == model) & F.col("annotated_label").isNotNull()).select(*keys).distinct()
    rows = pairs.join(done, keys, "left_anti").join(counts(annotations, keys), keys, "left")
    return rows.where((F.coalesce("yes_votes", F.lit(0)) < needed) & (F.coalesce("no_votes", F.lit(0)) < needed)).drop("yes_votes", "no_votes")


def unfinished(rows: DataFrame, done: DataFrame, key: str, distinct: bool = False) -> DataFrame:
    """Rows whose key isn't done; ``distinct`` also drops later rows of the same key in this input."""
    left = rows.join(done.select(key).distinct(), key, "left_anti")
    return left.dropDuplicates([key]) if distinct else left
