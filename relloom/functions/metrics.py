"""Ranking, classification and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POWER = 1.609


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def mean_score(a, b) -> Column:
    return (_column(a) + _column(b)) / F.lit(2.0)


def revised(score, power: float = POWER) -> Column:
    """Score to a power; null stays null."""
    return F.pow(_column(score), F.lit(power))


def yes_probability(yes, no, missing: float = -10.0) -> Column:
    """Softmax of two log probabilities; a missing one counts as ``missing``."""
    a, b = F.exp(F.coalesce(_column(yes), F.lit(missing))), F.exp(F.coalesce(_column(no), F.lit(missing)))
    return a / (a + b)


def squared_sigmoid_loss(logit, target) -> Column:
    return F.pow(1 / (1 + F.exp(-_column(logit))) - _column(target), F.lit(2.0))


def posterior(positive, negative, prior: float) -> Column:
    a, b = _column(positive) * prior, _column(negative) * (1 - prior)
    return F.when(a + b > 0, a / (a + b))


def gain(relevance, rank) -> Column:
    """Linear gain at a rank from 1, discounted; grades of 0 or less gain nothing."""
    return F.when(_column(relevance) > 0, _column(relevance).cast("double") / F.log2(_column(rank) + F.lit(1.0))).otherwise(F.lit(0.0))


def dcg(relevances: Column, k: int = 10) -> Column:
    """DCG of an array of grades in rank order."""
    gains = F.transform(F.slice(relevances, 1, k), lambda x, i: F.when(x > 0, x.cast("double") / F.log2(i + F.lit(2.0))).otherwise(F.lit(0.0)))
    return F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)


def ranked(scores: Column, relevances: Column) -> Column:
    """Relevances by falling score; ties keep the input's order."""
    both = F.transform(F.arrays_zip(scores.alias("s"), relevances.alias("r")), lambda x, i: F.struct((-x["s"]).alias("s"), i.alias("i"), x["r"].alias("r")))
    return F.transform(F.array_sort(both), lambda x: x["r"])


def ndcg(scores: Column, relevances: Column, k: int = 10) -> Column:
    """NDCG among the scored candidates; 0 when none is relevant."""
    ideal = dcg(F.sort_array(relevances, asc=False), k)
    return F.when(ideal > 0, dcg(ranked(scores, relevances), k) / ideal).otherwise(F.lit(0.0))


def guarded(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(_column(b) != 0, _column(a) / _column(b)).otherwise(F.lit(0.0))


def matches(left, right) -> Column:
    """'yes' where both are equal or both null."""
    return F.when(_column(left).eqNullSafe(_column(right)), "yes").otherwise("no")
