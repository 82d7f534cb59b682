"""Query-document pairs from scored document lists, and filters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import explode_strict
from ..functions.metrics import mean_score


def from_scored_lists(df: DataFrame, keys: list[str], documents: str, first: str, second: str) -> DataFrame:
    """keys, pos, document, score: a row for each document with the mean of two aligned score lists; sizes must agree."""
    rows = explode_strict(df, keys, document=documents, one=first, two=second)
    return rows.select(*keys, "pos", "document", mean_score("one", "two").alias("score"))


def without_markers(df: DataFrame, text: str, markers: list[str]) -> DataFrame:
    """Rows whose text contains none of the markers (case-sensitive)."""
    kept = F.lit(True)
    for m in markers:
        kept = kept & ~F.col(text).contains(m)
    return df.where(F.coalesce(kept, F.lit(True)))


def truncated_pairs(df: DataFrame, query: str, document: str, document_tokens: int, pair_tokens: int) -> DataFrame:
    """Documents cut to a number of tokens; then pairs that are still too long are dropped."""
    cut = df.withColumn("was_cut", tx.token_count(document) > document_tokens).withColumn(document, tx.truncated(document, document_tokens))
    return cut.where(tx.token_count(query) + F.least(tx.token_count(document), F.lit(document_tokens)) <= pair_tokens)


def teacher_gate(pos: list[Column], neg: list[Column], least: float = 0.5, n_pos: int = 1, n_neg: int = 7) -> Column:
    """Each scorer and their mean: every positive at least ``least``, none below any negative; exact list sizes."""
    mean = lambda a, b: F.zip_with(a, b, lambda x, y: (x + y) / F.lit(2.0))
    ok = (F.size(pos[0]) == n_pos) & (F.size(neg[0]) == n_neg)
    for p, n in [*zip(pos, neg), (mean(*pos), mean(*neg))]:
        ok = ok & F.forall(p, lambda x: x >= least) & (F.array_min(p) >= F.array_max(n))
    return ok


def with_last(df: DataFrame, lookup: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``value`` of the last lookup row of each key; keys that the lookup lacks get null."""
    last = lookup.groupBy(key).agg(F.max_by(value, order).alias(value))
    return df.join(last, key, "left")


def split_instruction(df: DataFrame, query: str, pos: str, neg: str) -> DataFrame:
    """Triples from raw rows: the query follows the one instruction mark; lists are cleaned, rows without either are dropped."""
    parts = F.split(tx.strip(query), "\n Query: ")
    rows = df.where(F.size(parts) == 2).withColumn(query, tx.strip(F.element_at(parts, 2)))
    rows = rows.withColumn(pos, tx.clean_array(pos)).withColumn(neg, tx.clean_array(neg))
    return rows.where((F.length(query) >= 2) & (F.size(pos) > 0) & (F.size(neg) > 0))


def valid_instructions(df: DataFrame, languages: list[str], barred: list[str]) -> DataFrame:
    """instruction, lang, cate of rows with a first turn, a wanted language and an allowed last category."""
    cate = F.element_at(F.when(F.size("label.cate_ability_zh") > 0, F.col("label.cate_ability_zh")), -1)
    rows = df.select(tx.strip(F.get("conversations", F.lit(0))["value"]).alias("instruction"), F.col("langdetect").alias("lang"), cate.alias("cate"))
    return rows.where((F.col("instruction") != "") & F.col("lang").isin(*languages) & F.col("cate").isNotNull() & ~F.col("cate").isin(*barred))


def without_flagged(df: DataFrame, flags: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows whose key isn't flagged true; unknown keys stay."""
    return df.join(flags.where(F.col(flag)).select(key).distinct(), key, "left_anti")
