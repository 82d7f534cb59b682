"""Search results of three providers as one list of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import sampled
from ..functions.hashing import hash01
from ..functions.text import base64_run, strip

RAW_SHARE, LONGEST_RUN, MOST = 1 / 11, 1000, 10


def chosen_content(content: Column, raw: Column, u: Column) -> Column:
    """Content ten times as often as raw text; raw text only if its longest base64 run is short; whichever is there."""
    content, raw = strip(F.coalesce(content, F.lit(""))), strip(F.coalesce(raw, F.lit("")))
    has, usable = content != "", (raw != "") & (base64_run(raw) < LONGEST_RUN)
    return F.when(has & usable, F.when(u < 1 - RAW_SHARE, content).otherwise(raw)).when(has, content).when(usable, raw)


def decorated(title: Column, text: Column, u: Column) -> Column:
    """Half without a title, a quarter with it on a line of its own, a quarter with both named; without a title, the text."""
    title = strip(F.coalesce(title, F.lit("")))
    return F.when((title == "") | (u < 0.5), text).when(u < 0.75, F.concat(title, F.lit("\n"), text)).otherwise(F.concat(F.lit("title: "), title, F.lit("\ncontent: "), text))


def topk_documents(df: DataFrame, key: str, results: Column, seed: str = "search", answer: Column | None = None) -> DataFrame:
    """key, docs: at most ten documents of each row's results (array of title, content, raw_content); rows without any are dropped.

    A provider's own answer comes before its results, as it is.
    """
    u = lambda what, i: hash01(f"{seed}-{what}", F.concat_ws(".", F.col(key).cast("string"), i.cast("string")))
    texts = F.transform(results, lambda r, i: decorated(r["title"], chosen_content(r["content"], r["raw_content"], u("raw", i)), u("title", i)))
    if answer is not None:
        texts = F.concat(F.array(strip(answer)), texts)
    docs = F.filter(texts, lambda x: strip(F.coalesce(x, F.lit(""))) != "")
    rows = df.select(key, docs.alias("docs")).where(F.size("docs") > 0)
    return rows.select(key, F.when(F.size("docs") > MOST, sampled(F.col("docs"), MOST, seed, F.col(key))).otherwise(F.col("docs")).alias("docs"))


def provider_results(extra: Column) -> Column:
    """Results as array<struct<title, content, raw_content>> from a struct with one provider's response; none raises.

    Null where the response has no list of results, so that such a row is dropped. The first of the providers that is there counts.
    """
    as_one = lambda xs, text, raw: F.transform(xs, lambda r: F.struct(r["title"].alias("title"), r[text].alias("content"), (r[raw] if raw else F.lit(None).cast("string")).alias("raw_content")))
    return (
        F.when(extra["original_tavily_result"].isNotNull(), as_one(extra["original_tavily_result"]["results"], "content", "raw_content"))
        .when(extra["original_zhipu_result"].isNotNull(), as_one(extra["original_zhipu_result"], "content", None))
        .when(extra["original_exa_result"].isNotNull(), as_one(extra["original_exa_result"]["results"], "text", None))
        .otherwise(F.raise_error(F.lit("unknown search source")))
    )


def provider_answer(extra: Column) -> Column:
    """The answer that one of the providers gives beside its results."""
    return extra["original_tavily_result"]["answer"]


def merged_extra(extra: Column, **added: Column) -> Column:
    """A map with further keys; null counts as empty."""
    return F.map_concat(F.coalesce(extra, F.create_map().cast("map<string,string>")), *[F.create_map(F.lit(k), v.cast("string")) for k, v in added.items()])
