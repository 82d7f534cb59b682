"""Pluggable calls (models, search, translation) with resume: the relational part is native, the call is injected.

A client is a function from a list of prompts to a list of texts or None; it runs in Python workers over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_token_label
from ..session import exists, written
from .pairs import without_flagged

Client = Callable[[list[str]], list[str | None]]


def retried(client: Client, times: int) -> Callable[[list[str]], tuple[list[str | None], Exception | None]]:
    """Asks again, up to ``times``, for what came back as None or raised; the answers, and what the last attempt raised."""

    def ask(prompts: list[str]) -> tuple[list[str | None], Exception | None]:
        out: list[str | None] = [None] * len(prompts)
        failed = None
        for _ in range(times + 1):
            left = [k for k, x in enumerate(out) if x is None]
            if not left:
                break
            try:
                for k, x in zip(left, client([prompts[k] for k in left])):
                    out[k] = x
                failed = None
            except Exception as raised:
                failed = raised
        return out, failed

    return ask


def called(df: DataFrame, prompt: str, output: str, client: Client, retries: int = 1, error: str | None = None) -> DataFrame:
    """``df`` with the client's answer to each prompt; null where it gave none.

    An error that the client raised in the last attempt goes to column ``error`` of the rows without an answer, if that is
    given; else it is raised, so that an outage doesn't look like empty answers.
    """
    fields = [T.StructField(output, T.StringType()), *([T.StructField(error, T.StringType())] if error else [])]
    schema = T.StructType([*df.schema.fields, *fields])
    ask = retried(client, retries)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found, failed = ask(part[prompt].tolist())
            if failed is not None and not error:
                raise failed
            part = part.assign(**{output: pd.Series(found, index=part.index, dtype=object)})
            if error:
                told = None if failed is None else f"{type(failed).__name__}: {failed}"
                part = part.assign(**{error: pd.Series([told if x is None else None for x in found], index=part.index, dtype=object)})
            yield part

    return df.mapInPandas(run, schema)


def resumed(df: DataFrame, done: DataFrame | None, key: str, prompt: str, output: str, client: Client, retries: int = 1, error: str | None = None) -> DataFrame:
    """Answers for rows whose key has none yet: a null answer in ``done`` is tried again."""
    if done is not None:
        df = df.join(done.where(F.col(output).isNotNull()).select(key).distinct(), key, "left_anti")
    return called(df, prompt, output, client, retries, error)


def translated(df: DataFrame, text: str, client: Client) -> DataFrame:
    """The text translated, or as it was where that failed."""
    return called(df, text, "_new", client, 3, "_error").withColumn(text, F.coalesce("_new", text)).drop("_new", "_error")


def repaired(df: DataFrame, prompt: str, output: str, wrong, clients: list[Client]) -> DataFrame:
    """Rows whose answer is ``wrong`` (a column) are asked again by each client in turn; the last answer stays.

    Each round is written before the next reads it, so a row is asked once a round, whatever is done with the result, and an
    answer that has been judged is the one that stays.
    """
    df = written(df)
    for client in clients:
        good, bad = df.where(~F.coalesce(wrong, F.lit(True))), df.where(F.coalesce(wrong, F.lit(True)))
        df = written(good.unionByName(called(bad.drop(output), prompt, output, client, error="_error").drop("_error")))
    return df


def run_resumed(spark: SparkSession, df: DataFrame, path: str, key: str, prompt: str, output: str, client: Client, retries: int = 1) -> DataFrame:
    """A whole run: keys without an answer in the store at ``path`` are asked and appended, failed ones too; then each key's row.

    A key that has an answer is never asked again; one whose attempts all failed is asked by the next run. Repeated keys are
    asked once. Of a key's stored rows the one with an answer counts.
    """
    todo = df.where(F.col(key).isNotNull() & F.col(prompt).isNotNull()).groupBy(key).agg(F.min(prompt).alias(prompt))
    done = spark.read.parquet(path).select(key, output) if exists(spark, path) else None
    resumed(todo, done, key, prompt, output, client, retries, "error").write.mode("append").parquet(path)
    answers = spark.read.parquet(path).groupBy(key).agg(F.max(output).alias(output))
    return df.join(answers, key, "left")


def voted(spark: SparkSession, df: DataFrame, root: str, key: str, prompt: str, models: dict[str, Client], need: int = 3) -> DataFrame:
    """An annotation run: each model in turn labels the keys whose majority isn't settled; each has a store of its own.

    Returns key, yes_votes, no_votes and annotated_label (null without ``need`` equal votes).
    """
    rows = df.select(key, prompt)
    votes = None
    for name, client in models.items():
        left = rows if votes is None else rows.join(votes.where(F.greatest("yes_votes", "no_votes") >= need).select(key), key, "left_anti")
        run_resumed(spark, left, f"{root}/{name}", key, prompt, "answer", client)
        stores = [spark.read.parquet(f"{root}/{m}").groupBy(key).agg(F.max("answer").alias("answer")) for m in models if exists(spark, f"{root}/{m}")]
        every = reduce(DataFrame.unionByName, stores).select(key, first_token_label("answer").alias("label"))
        votes = every.groupBy(key).agg(F.count_if(F.col("label") == "yes").alias("yes_votes"), F.count_if(F.col("label") == "no").alias("no_votes"))
    label = F.when(F.col("yes_votes") >= need, "yes").when(F.col("no_votes") >= need, "no")
    return rows.select(key).distinct().join(votes, key, "left").na.fill(0, ["yes_votes", "no_votes"]).withColumn("annotated_label", label)


def run_in_rounds(spark: SparkSession, df: DataFrame, path: str, key: str, prompt: str, output: str, client: Client, rounds: int, retries: int = 1) -> DataFrame:
    """``run_resumed`` in ``rounds`` parts by hash of the key, each committed before the next begins: a crash costs one part."""
    for k in range(rounds):
        run_resumed(spark, df.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == k), path, key, prompt, output, client, retries)
    answers = spark.read.parquet(path).groupBy(key).agg(F.max(output).alias(output))
    return df.join(answers, key, "left")


def flagged_out(spark: SparkSession, df: DataFrame, path: str, text: str, client: Client, yes: str = "yes") -> DataFrame:
    """A filter run: distinct texts that have no verdict in the store at ``path`` are asked, and rows whose text is ``yes`` go."""
    texts = df.select(text).where(F.col(text).isNotNull()).distinct().withColumn("_ask", F.col(text))
    verdicts = run_resumed(spark, texts, path, text, "_ask", "verdict", client).select(text, (first_token_label("verdict") == yes).alias("_flag"))
    return without_flagged(df, verdicts, text, "_flag")


def scattered(df: DataFrame, index: str, shards: int) -> DataFrame:
    """Rows with their shard, dealt round robin by a dense index and laid out so that a task holds one shard."""
    return df.withColumn("shard", F.pmod(F.col(index), F.lit(shards)).cast("int")).repartition(shards, "shard")


def collated(parts: list[DataFrame], index: str) -> DataFrame:
    """The shards' results in the order of the index."""
    return reduce(DataFrame.unionByName, parts).orderBy(index)
