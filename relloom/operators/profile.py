"""Profiles: summaries, two kinds of percentiles, histograms, counts of counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import null_safe

CUTS = 255


def ordered_values(df: DataFrame, by: list[str], value: str, places: Callable[[Column], Column]) -> DataFrame:
    """by, i, value: of each group's n sorted values those at ``places(n)``, an array of positions from 0; i is the array's index.

    Values are counted, and each group's distinct values are cut into CUTS + 1 runs by a sketch. Positions are found from the
    runs' sums, and only the runs that hold one are sorted, so no task sees all of a group's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)]), F.lit(10_000)).alias("_cuts"))
    runs = null_safe(counts, cuts, by, "inner").withColumn("_run", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = runs.groupBy(*by, "_run").agg(F.sum("_n").alias("_m"))
    before, every = Window.partitionBy(*by).orderBy("_run"), Window.partitionBy(*by)  # at most CUTS + 1 rows of a group
    sums = sums.withColumn("_before", F.sum("_m").over(before) - F.col("_m")).withColumn("_all", F.sum("_m").over(every))
    asked = F.transform(places(F.col("_all")), lambda at, i: F.struct(i.alias("i"), (at - F.col("_before")).cast("long").alias("at")))
    sums = sums.withColumn("_asked", F.filter(asked, lambda x: (x["at"] >= 0) & (x["at"] < F.col("_m")))).where(F.size("_asked") > 0)
    rows = null_safe(runs, sums.select(*by, "_run", "_asked"), [*by, "_run"], "inner")
    upto = F.sum("_n").over(Window.partitionBy(*by, "_run").orderBy(value))
    rows = rows.withColumn("_upto", upto).withColumn("_x", F.explode("_asked"))
    return rows.where((F.col("_upto") - F.col("_n") <= F.col("_x.at")) & (F.col("_x.at") < F.col("_upto"))).select(*by, "_x.i", value)


def interpolated(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, i, value interpolated at (n - 1) * share for each of ``shares``, as a double."""
    place = lambda n, i: (n - 1) * F.get(F.array(*map(F.lit, shares)), F.floor(i / 2).cast("int"))
    both = lambda n: F.transform(F.sequence(F.lit(0), F.lit(2 * len(shares) - 1)), lambda i: F.when(i % 2 == 0, F.floor(place(n, i))).otherwise(F.ceil(place(n, i))))
    ends = ordered_values(df, by, value, both).withColumn("_k", F.floor(F.col("i") / 2).cast("int"))
    ends = ends.groupBy(*by, "_k").agg(F.min(F.col(value).cast("double")).alias("_low"), F.max(F.col(value).cast("double")).alias("_high"))
    n = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_all"))
    at = (F.col("_all") - 1) * F.get(F.array(*map(F.lit, shares)), F.col("_k"))
    part = at - F.floor(at)
    return null_safe(ends, n, by, "inner").select(*by, F.col("_k").alias("i"), ((1 - part) * F.col("_low") + part * F.col("_high")).alias("value"))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    rows = df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    return with_median(rows, df, by, value).select(*by, "n", "least", "most", "mean", "median", "sd")


def with_median(rows: DataFrame, df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` of groups with the median of ``value`` in ``df``; null where a group has no value."""
    return null_safe(rows, interpolated(df, by, value, [0.5]).select(*by, F.col("value").alias("median")), by, "left")


def histogram(df: DataFrame, value: str, width: float, bar: int = 50) -> DataFrame:
    """bucket, n and a bar length relative to the fullest bucket; empty buckets have no row."""
    counts = df.groupBy(F.floor(F.col(value) / F.lit(width)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("bucket", "n", F.floor(F.col("n") / F.col("most") * bar).cast("int").alias("bar"))  # one row of maxima


def nearest_percentiles(df: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """by, p, value at position min(floor(n * p / 100), n - 1) from 0 of the sorted values."""
    found = ordered_values(df, by, value, lambda n: F.array(*[F.least(F.floor(n * p / 100), n - 1) for p in percents]))
    return found.select(*by, F.get(F.array(*map(F.lit, percents)), F.col("i")).alias("p"), F.col(value).alias("value"))


def linear_percentiles(df: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """by, p, value interpolated at (n - 1) * p / 100."""
    found = interpolated(df, by, value, [p / 100 for p in percents])
    return found.select(*by, F.get(F.array(*map(F.lit, percents)), F.col("i")).alias("p"), "value")


def counts_of_counts(df: DataFrame, key: str) -> DataFrame:
    """size, n: how many keys occur ``size`` times."""
    return df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def bucketed(df: DataFrame, score: str, value: str, width: float) -> DataFrame:
    """bucket, n, mean, median of ``value`` by score bucket."""
    rows = df.select(F.floor(F.col(score) / F.lit(width)).cast("int").alias("bucket"), value)
    return with_median(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(value).alias("mean")), rows, ["bucket"], value)


def top_counts(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The ``n`` most frequent keys; ties by first occurrence."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(n)


def grouped_counts(df: DataFrame, one: str, two: str) -> DataFrame:
    """Counts by each column and by both, in one pass."""
    return df.groupingSets([[one], [two], [one, two]], one, two).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def reuse(df: DataFrame, one: str, two: str) -> DataFrame:
    """Rows, distinct values of two columns and the rows for each distinct value."""
    out = df.agg(F.count("*").alias("n"), F.countDistinct(one).alias("n_one"), F.countDistinct(two).alias("n_two"))
    return out.select("*", F.try_divide("n", "n_one").alias("per_one"), F.try_divide("n", "n_two").alias("per_two"))


#: The percentiles of the length report.
LENGTH_PERCENTS = (25, 50, 75, 90, 91, 92, 93, 94, 95, 96, 97, 98, 99)


def lengths(df: DataFrame, texts: dict[str, str], size) -> DataFrame:
    """field, n, mean, least, most and the interpolated percentiles of the sizes of each field's texts; a field may be an array."""
    kinds = dict(df.dtypes)
    as_array = lambda c: F.col(c) if kinds[c].startswith("array") else F.array(F.col(c))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), as_array(c).alias("texts")) for name, c in texts.items()]))
    rows = df.select(each.alias("x")).select("x.field", F.explode("x.texts").alias("text")).where("text is not null").select("field", size("text").alias("size"))
    at = F.percentile("size", F.array(*[F.lit(p / 100) for p in LENGTH_PERCENTS]))
    rows = rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.min("size").alias("least"), F.max("size").alias("most"), at.alias("at"))
    return rows.select("field", "n", "mean", "least", "most", *[F.get("at", F.lit(i)).alias(f"p{p}") for i, p in enumerate(LENGTH_PERCENTS)])
