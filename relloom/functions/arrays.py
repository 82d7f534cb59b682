"""Parallel arrays: strict zips, paired filters and hash-ordered samples of an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import seeded


def strict_zip(**arrays: Column) -> Column:
    """Zipped arrays of one size; other sizes raise, as arrays_zip would fill with null."""
    items = list(arrays.items())
    same = F.lit(True)
    for _, a in items[1:]:
        same = same & (F.size(a) == F.size(items[0][1]))
    zipped = F.arrays_zip(*[a.alias(n) for n, a in items])
    return F.when(same, zipped).otherwise(F.raise_error(F.lit("arrays of different sizes")))


def explode_strict(df: DataFrame, keys: list[str], **arrays: str) -> DataFrame:
    """keys, pos (from 0) and one column for each named array."""
    zipped = df.select(*keys, F.posexplode(strict_zip(**{n: F.col(c) for n, c in arrays.items()})).alias("pos", "x"))
    return zipped.select(*keys, "pos", *[F.col(f"x.{n}").alias(n) for n in arrays])


def paired_filter(documents: Column, grades: Column) -> Column:
    """Structs (document, grade) without blank documents."""
    both = F.arrays_zip(documents.alias("document"), grades.alias("grade"))
    return F.filter(both, lambda x: F.regexp_replace(F.coalesce(x["document"], F.lit("")), r"(?U)\s+", "") != "")


def sampled(array: Column, n: int, seed: str, key: Column) -> Column:
    """At most ``n`` elements of a string array, first in hash order."""
    tagged = F.transform(array, lambda x, i: F.struct(seeded(seed, F.concat_ws("|", key.cast("string"), i.cast("string"), x)).alias("h"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(tagged), 1, n), lambda t: t["x"])


def batches_by_budget(sizes: Column, start: Column, budget: int, most: int) -> Column:
    """The batch number (from 0) of each element: greedy, each batch within ``budget`` units (``start`` included) and ``most`` elements."""
    first = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), start.cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def add(state, size):
        full = (state["n"] > 0) & ((state["used"] + size > budget) | (state["n"] >= most))
        batch = F.when(full, state["batch"] + 1).otherwise(state["batch"])
        return F.struct(
            batch.alias("batch"),
            F.when(full, F.lit(1)).otherwise(state["n"] + 1).alias("n"),
            (F.when(full, start.cast("long")).otherwise(state["used"]) + size).alias("used"),
            F.concat(state["out"], F.array(batch)).alias("out"),
        )

    return F.aggregate(F.transform(sizes, lambda x: x.cast("long")), first, add, lambda s: s["out"])
