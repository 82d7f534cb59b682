"""Score thresholds from class densities: kernel density, posterior, crossings, precision and recall.

Scores are binned before anything meets the grid, so the work is grid times bins, whatever the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash01
from ..functions.metrics import posterior

BIN = 1e-4


def sweep(scores: DataFrame, levels: int = 100) -> DataFrame:
    """level, threshold and, inclusive both ways, hits, precision and recall above (positives) and below (negatives).

    ``scores``: score, positive (boolean). Rows are counted by the two levels they touch; the rest is running sums. A score
    meets the thresholds level / levels themselves: the product may be off by one rounding, so its level is corrected by one.
    """
    s, at = F.col("score"), lambda level: level / F.lit(float(levels))
    low, high = F.floor(s * levels), F.ceil(s * levels)
    up = F.when(at(low + 1) <= s, low + 1).when(at(low) > s, low - 1).otherwise(low).cast("int")  # the last level at or below the score
    down = F.when(at(high - 1) >= s, high - 1).when(at(high) < s, high + 1).otherwise(high).cast("int")  # the first level at or above it
    p, n = F.col("positive").cast("long"), (~F.col("positive")).cast("long")
    above = scores.groupBy(up.alias("level")).agg(F.sum(p).alias("pa"), F.sum(n).alias("na"))
    below = scores.groupBy(down.alias("level")).agg(F.sum(p).alias("pb"), F.sum(n).alias("nb"))
    grid = scores.sparkSession.range(0, levels + 1, 1, 1).select(F.col("id").cast("int").alias("level"))
    rows = grid.join(F.broadcast(above), "level", "left").join(F.broadcast(below), "level", "left").na.fill(0)  # levels + 1 rows
    up_to, from_here = Window.orderBy("level"), Window.orderBy(F.desc("level"))
    rows = rows.select("level", *[F.sum(c).over(w).alias(c) for c, w in (("pa", from_here), ("na", from_here), ("pb", up_to), ("nb", up_to))])
    total = scores.agg(F.sum(p).alias("p"), F.sum(n).alias("n"))
    rows = rows.crossJoin(F.broadcast(total))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    return rows.select(
        "level", (c("level") / F.lit(float(levels))).alias("threshold"), (c("pa") + c("na")).alias("hits_above"), (c("pb") + c("nb")).alias("hits_below"),
        ratio(c("pa"), c("pa") + c("na")).alias("precision_above"), ratio(c("pa"), c("p")).alias("recall_above"),
        ratio(c("nb"), c("nb") + c("pb")).alias("precision_below"), ratio(c("nb"), c("n")).alias("recall_below"),
    )


def densities(scores: DataFrame, low: float, high: float, points: int) -> DataFrame:
    """i, x, pos, neg: Gaussian kernel densities of both classes on a grid, Scott's bandwidth."""
    spark = scores.sparkSession
    binned = scores.groupBy("positive", (F.round(F.col("score") / BIN) * BIN).alias("s")).agg(F.count("*").alias("w"))
    width = scores.groupBy("positive").agg(F.count("*").alias("n"), (F.pow(F.count("*").cast("double"), F.lit(-0.2)) * F.stddev_samp("score")).alias("h"))
    step = (high - low) / (points - 1)
    grid = spark.range(points).select(F.col("id").alias("i"), (F.lit(low) + F.col("id") * F.lit(step)).alias("x"))
    bins = binned.join(F.broadcast(width), "positive")  # at most 2 / BIN rows, whatever the input
    z = (F.col("x") - F.col("s")) / F.col("h")
    kernel = F.col("w") * F.exp(-z * z / 2) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    both = grid.crossJoin(F.broadcast(bins))
    return both.groupBy("i", "x").agg(F.sum(F.when(F.col("positive"), kernel).otherwise(0.0)).alias("pos"), F.sum(F.when(~F.col("positive"), kernel).otherwise(0.0)).alias("neg"))


def crossings(curve: DataFrame, levels: list[float]) -> DataFrame:
    """level, threshold: where ``y`` over ``x`` last crosses each level, interpolated; levels that it never crosses are left out."""
    step = curve.select("i", "x", "y", F.lead("x").over(Window.orderBy("i")).alias("x1"), F.lead("y").over(Window.orderBy("i")).alias("y1")).where("x1 is not null")
    rows = step.select("*", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    rows = rows.where(F.signum(F.col("y") - F.col("level")) != F.signum(F.col("y1") - F.col("level")))
    last = rows.groupBy("level").agg(F.max_by(F.struct("x", "y", "x1", "y1"), "i").alias("c"))
    flat = F.abs(F.col("c.y1") - F.col("c.y")) < 1e-12
    t = (F.col("level") - F.col("c.y")) / (F.col("c.y1") - F.col("c.y"))
    return last.select("level", F.when(flat, F.col("c.x")).otherwise(F.col("c.x") + t * (F.col("c.x1") - F.col("c.x"))).alias("threshold"))


def thresholds(scores: DataFrame, levels: list[float], prior: float = 0.125, points: int = 401, low: float = -0.05, high: float = 1.05) -> DataFrame:
    """level, threshold: the score at which the posterior of the positive class reaches each level."""
    curve = densities(scores, low, high, points).select("i", "x", posterior("pos", "neg", prior).alias("y")).where("y is not null")
    return crossings(curve, levels)


def calibrated(scores: DataFrame, key: str, above: list[float], below: list[float], share: float = 0.7, prior: float = 0.125, points: int = 10_000, margin: float = 0.05, seed: str = "calibrate") -> DataFrame:
    """direction, level, threshold, precision, recall, hits: thresholds found on one part of the queries, judged on the other.

    ``scores``: ``key``, score, positive. Queries are split by hash, so a query's rows stay together. The grid runs over the
    scores' own range and ``margin`` beyond. At a threshold, rows at or above it (or at or below it) count as hits. At most one
    row for each level reaches the driver, and the validation part is read once for all of them.
    """
    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    fitted = hash01(seed, key) < share
    found = []
    if ends["low"] is not None:
        curve = thresholds(scores.where(fitted), sorted({*above, *below}), prior, points, ends["low"] - margin, ends["high"] + margin)
        at = {r["level"]: r["threshold"] for r in curve.collect()}
        found = [("above", x, at[x]) for x in above if x in at] + [("below", x, at[x]) for x in below if x in at]
    kind = "direction string, level double, threshold double, precision double, recall double, hits long"
    if not found:
        return scores.sparkSession.createDataFrame([], kind)
    good = lambda way: F.col("positive") if way == "above" else ~F.col("positive")
    hit = lambda way, t: F.col("score") >= t if way == "above" else F.col("score") <= t
    counts = [c for k, (way, _, t) in enumerate(found) for c in (F.count_if(hit(way, t)).alias(f"n{k}"), F.count_if(hit(way, t) & good(way)).alias(f"g{k}"))]
    n = scores.where(~fitted).agg(*counts, F.count_if(good("above")).alias("above"), F.count_if(good("below")).alias("below")).first()
    ratio = lambda a, b: a / b if b else 0.0
    rows = [(way, level, t, ratio(n[f"g{k}"], n[f"n{k}"]), ratio(n[f"g{k}"], n[way]), n[f"n{k}"]) for k, (way, level, t) in enumerate(found)]
    return scores.sparkSession.createDataFrame(rows, kind)


#: The percentiles of the summary.
PERCENTS = (5, 10, 25, 50, 75, 90, 95)


def summary(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """positive, n, mean, sd (of the population), least, most, p5 to p95 (interpolated), and the share on its own side of ``threshold``."""
    own = F.when(F.col("positive"), F.col("score") > threshold).otherwise(F.col("score") < threshold)
    at = F.percentile("score", F.array(*[F.lit(p / 100) for p in PERCENTS]))
    rows = scores.groupBy("positive").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.min("score").alias("least"), F.max("score").alias("most"), at.alias("at"), F.avg(own.cast("double")).alias("own_side"))
    return rows.select("positive", "n", "mean", "sd", "least", "most", *[F.get("at", F.lit(i)).alias(f"p{p}") for i, p in enumerate(PERCENTS)], "own_side")
