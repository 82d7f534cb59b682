"""Reproducible sampling. Every choice follows ``hash01`` or the MD5 order of a seed and a key, so runs agree.

"The first n of a group in hash order" never sorts a group in one task: the hashes are binned, bins are counted (a small
aggregate with map-side partial sums), whole bins below the cut are kept by a filter alone, and only the one bin that the cut
runs through is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash01, seeded
from ..session import written

BINS = 4096


def bernoulli(df: DataFrame, key: str | Column, share: float, seed: str) -> DataFrame:
    return df.where(hash01(seed, key) < share)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null keys meet; the left side's keys stay. Without keys the right side has one row."""
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] or F.lit(True)
    return left.join(right.withColumnsRenamed({k: f"_of_{k}" for k in keys}), same, how).drop(*(f"_of_{k}" for k in keys))


def first_of_groups(df: DataFrame, groups: list[str], key: str, seed: str, caps: DataFrame | int) -> DataFrame:
    """At most ``cap`` rows of each group, first in the order of (hash, key).

    ``caps`` holds the groups' columns and ``cap``; a group that it lacks is kept whole. Null is a group like others. Rows'
    columns are unchanged.
    """
    names = df.columns
    tagged = df.withColumn("_h", seeded(seed, key)).withColumn("_bin", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = tagged.groupBy(*groups, "_bin").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*groups).orderBy("_bin")  # BINS rows of a group at most
    if isinstance(caps, int):
        counts = counts.withColumn("cap", F.lit(caps))
    else:
        counts = null_safe(counts, caps, groups, "inner") if groups else counts.crossJoin(F.broadcast(caps.limit(1)))
    cut = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    # the bin that the cut runs through, and how many of its rows are left; a group below its cap has none
    cut = cut.where((F.col("_before") <= F.col("cap")) & (F.col("_before") + F.col("_n") > F.col("cap")))
    cut = cut.groupBy(*groups).agg(F.min("_bin").alias("_cut"), F.min_by(F.col("cap") - F.col("_before"), "_bin").alias("_left"))
    cut = written(cut)  # a row for each group; both halves below read it, so the counting isn't done for each
    if groups:
        joined = null_safe(tagged, cut, groups, "left")
    else:
        joined = tagged.join(F.broadcast(cut), F.lit(True), "left")
    whole = joined.where(F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut")))
    rank = Window.partitionBy(*groups, "_bin").orderBy("_h", key)
    part = joined.where(F.col("_bin") == F.col("_cut")).withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= F.col("_left"))
    return whole.select(*names).union(part.select(*names))


def first_rows(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The first ``n`` rows in hash order, for a small constant n (a top-k, no global sort)."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def balanced_buckets(
    df: DataFrame, score: str, key: str, seed: str = "bal", width: float = 0.05, low: float = 0.20, high: float = 0.95, ratio: float = 0.8, steps: tuple[tuple[float, float], ...] = ((0.65, 1.7),)
) -> DataFrame:
    """Score buckets balanced: outer ones whole, each middle one at most base * multiplier rows.

    base = int(min(size / multiplier) / ratio) over the middle buckets, so every middle bucket fills ``ratio`` of its cap.
    The bucket's lower edge is number * width, not the score. Adds ``bucket``.
    """
    df = df.withColumn("bucket", F.floor(F.col(score) / F.lit(width)).cast("int"))
    edge = F.col("bucket") * F.lit(width)
    times = F.lit(1.0)
    for at, value in sorted(steps):
        times = F.when(edge >= F.lit(at), F.lit(value)).otherwise(times)
    sizes = df.groupBy("bucket").agg(F.count("*").alias("n")).where((edge >= F.lit(low)) & (edge < F.lit(high))).withColumn("times", times)
    sizes = written(sizes)  # a row for each bucket
    base = sizes.agg(F.floor(F.min(F.col("n") / F.col("times")) / F.lit(ratio)).alias("base"))
    caps = sizes.crossJoin(F.broadcast(base)).select("bucket", F.floor(F.col("base") * F.col("times")).alias("cap"))  # one row by buckets
    return first_of_groups(df, ["bucket"], key, seed, F.broadcast(caps))


def at_ratio(df: DataFrame, kind: str, one: str, two: str, key: str, parts: tuple[int, int] = (2, 3), seed: str = "ratio") -> DataFrame:
    """Rows of two kinds cut to a ratio by shrinking one of them, the way that keeps more rows; as they are if neither can be."""
    wanted = F.lit(parts[1] / parts[0])
    n = df.agg(F.count_if(F.col(kind) == one).alias("n1"), F.count_if(F.col(kind) == two).alias("n2"))
    n = n.withColumn("m2", F.floor(F.col("n1") * wanted)).withColumn("m1", F.floor(F.col("n2") / wanted))
    fits2, fits1 = F.col("m2") <= F.col("n2"), F.col("m1") <= F.col("n1")
    cut2 = fits2 & (~fits1 | (F.col("n1") + F.col("m2") >= F.col("m1") + F.col("n2")))
    caps = n.select(F.explode(F.array(F.struct(F.lit(one).alias(kind), F.when(~cut2 & fits1, F.col("m1")).otherwise(F.col("n1")).alias("cap")), F.struct(F.lit(two).alias(kind), F.when(cut2, F.col("m2")).otherwise(F.col("n2")).alias("cap")))).alias("x")).select("x.*")
    return first_of_groups(df.where(F.col(kind).isin(one, two)), [kind], key, seed, F.broadcast(caps))


def balanced_categories(df: DataFrame, lang: str, cate: str, key: str, langs: tuple[str, str], parts: tuple[int, int] = (7, 3), percent: float = 0.10, spread: float = 0.1, seed: str = "cate") -> DataFrame:
    """Per language, rare categories whole and the others near their median; then two languages at a ratio, cut in proportion.

    Rare: size at or below the given percentile of the language's category sizes. The proportional cut carries its remainder
    over categories in alphabetical order: a category keeps floor(running share) - floor(running share before it).
    """
    df = df.where(F.col(lang).isin(*langs))
    sizes = written(df.groupBy(lang, cate).agg(F.count("*").alias("n")))  # a row for each category
    rare = sizes.groupBy(lang).agg(F.percentile("n", F.lit(percent)).alias("rare"))
    sizes = sizes.join(F.broadcast(rare), lang)
    middle = sizes.where("n > rare").groupBy(lang).agg(F.floor(F.median("n")).alias("target"))
    sizes = sizes.join(F.broadcast(middle), lang, "left")
    low, high = F.floor(F.col("target") * F.lit(1 - spread)), F.floor(F.col("target") * F.lit(1 + spread))
    take = F.when(F.col("n") <= F.col("rare"), F.col("n")).otherwise(F.greatest(F.least("n", high), F.least(low, F.col("n"))))
    sizes = sizes.withColumn("take", take)
    pools = sizes.groupBy().agg(F.sum(F.when(F.col(lang) == langs[0], F.col("take"))).alias("a"), F.sum(F.when(F.col(lang) == langs[1], F.col("take"))).alias("b")).na.fill(0)
    two = F.floor(F.col("a") * F.lit(parts[1]) / F.lit(parts[0]))
    goals = pools.select("a", "b", F.when(two > F.col("b"), F.floor(F.col("b") * F.lit(parts[0]) / F.lit(parts[1]))).otherwise(F.col("a")).alias("ga"), F.least(two, F.col("b")).alias("gb"))
    goals = goals.select(F.explode(F.array(F.struct(F.lit(langs[0]).alias(lang), F.col("a").alias("pool"), F.col("ga").alias("goal")), F.struct(F.lit(langs[1]).alias(lang), F.col("b").alias("pool"), F.col("gb").alias("goal")))).alias("x")).select("x.*")
    running = Window.partitionBy(lang).orderBy(cate)  # a row for each category
    share = F.col("goal") / F.col("pool")
    cut = sizes.join(F.broadcast(goals), lang).withColumn("upto", F.sum("take").over(running))
    kept = F.floor(F.col("upto") * share + F.lit(1e-9)) - F.floor((F.col("upto") - F.col("take")) * share + F.lit(1e-9))
    caps = cut.select(lang, cate, F.when(F.col("pool") <= F.col("goal"), F.col("take")).otherwise(kept).alias("cap"))
    return first_of_groups(df, [lang, cate], key, seed, caps)


def split_queries(df: DataFrame, query: str, n: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(train, dev): dev holds all rows of ``n`` queries, first in hash order."""
    chosen = F.broadcast(df.select(query).distinct().orderBy(seeded(seed, query), query).limit(n))
    return df.join(chosen, query, "left_anti"), df.join(chosen, query, "left_semi")


def interleaved(spark, n_point: int, n_sft: int, ratio: float, seed: str = "mix") -> DataFrame:
    """pos, use_sft, local: which source each position takes and the index in it, the smaller source over and over.

    The running count is built in two levels, so no task sees all positions: counts by block, then within a block.
    """
    if not n_point and not n_sft:
        raise ValueError("both sources are empty")
    import math

    length = n_point or n_sft
    if n_point and n_sft:
        length = max(math.ceil(n_point / (1 - ratio)), math.ceil(n_sft / ratio))
    use = F.lit(bool(n_sft)) if not (n_point and n_sft) else hash01(seed, "pos") < ratio
    rows = spark.range(length).withColumnRenamed("id", "pos").withColumn("use_sft", use).withColumn("block", F.floor(F.col("pos") / 65536))
    sums = rows.groupBy("use_sft", "block").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("use_sft").orderBy("block")) - F.col("n"))
    within = F.row_number().over(Window.partitionBy("use_sft", "block").orderBy("pos")) - 1
    local = (F.col("before") + F.col("k")) % F.when(F.col("use_sft"), F.lit(max(n_sft, 1))).otherwise(F.lit(max(n_point, 1)))
    return rows.withColumn("k", within).join(F.broadcast(sums.drop("n")), ["use_sft", "block"]).select("pos", "use_sft", local.alias("local"))


def grouped_order(df: DataFrame, query: str, order: str, seed: str) -> DataFrame:
    """Queries in hash order with their rows side by side, as a range-partitioned sort."""
    return df.orderBy(seeded(seed, query), query, order)


def allocated(df: DataFrame, order: str, slots: int, cap: int) -> DataFrame:
    """Rows dealt round robin to ``slots`` in the order of a dense number from 0; beyond ``cap`` rows a slot: null."""
    slot = F.pmod(F.col(order), F.lit(slots))
    return df.withColumn("slot", F.when(F.floor(F.col(order) / slots) < cap, slot))


def length_batches(df: DataFrame, length: Column, key: str, size: int, seed: str = "length") -> DataFrame:
    """Rows with ``position`` in the order of length (ties in hash order) and ``batch``, so that a batch's texts are alike in length.

    Positions come from counts: by length and hash bin, then within one such group; no task sorts all rows.
    """
    rows = df.withColumn("_n", length.cast("long")).withColumn("_h", seeded(seed, key)).withColumn("_bin", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    counts = rows.groupBy("_n", "_bin").agg(F.count("*").alias("_many"))
    counts = counts.withColumn("_before", F.sum("_many").over(Window.orderBy("_n", "_bin")) - F.col("_many")).drop("_many")  # a row for each length and bin
    within = F.row_number().over(Window.partitionBy("_n", "_bin").orderBy("_h", key)) - 1
    placed = null_safe(rows.withColumn("_k", within), counts, ["_n", "_bin"], "inner")
    return placed.withColumn("position", F.col("_before") + F.col("_k")).withColumn("batch", F.floor(F.col("position") / size)).drop("_n", "_h", "_bin", "_before", "_k")
