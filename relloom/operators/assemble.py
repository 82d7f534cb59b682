"""The final training sets: loss types, targets, splits and the mix of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import asserted
from ..functions.hashing import seeded
from ..functions.metrics import revised
from ..functions.text import strip
from .sampling import first_of_groups, split_queries

LOSSES = ("point-wise", "sft", "point-wise;sft")


def loss_type(score: str = "revised_score", label: str = "annotated_label", middle: float = 0.5) -> Column:
    """Both losses where score and label agree, else only the text loss."""
    agree = ((F.col(score) > middle) & (F.col(label) == "yes")) | ((F.col(score) <= middle) & (F.col(label) == "no"))
    return F.when(agree, "point-wise;sft").otherwise("sft")


def sft_target(label: str = "annotated_label", evidence: str = "contribution_evidence") -> Column:
    """Label and evidence on two lines, stripped."""
    return strip(F.concat(F.coalesce(F.col(label), F.lit("")), F.lit("\n"), F.coalesce(F.col(evidence), F.lit(""))))


def checked(df: DataFrame) -> DataFrame:
    """Training rows; an unknown loss type or a score outside [0, 1] raises, whichever columns are read of them."""
    good_loss = F.coalesce(F.col("loss_type").isin(*LOSSES), F.lit(False))
    good_score = F.coalesce(F.col("revised_score").between(0, 1), F.lit(True))
    message = F.concat(F.lit("bad training row for query: "), F.coalesce("query", F.lit("")))
    return df.where(asserted(good_loss & good_score, message))


def marked(evidence: DataFrame, distilled: DataFrame, dev: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(point-wise rows, text rows, dev rows) of one corpus: dev holds all evidence rows of ``dev`` queries, first in hash order."""
    point = distilled.withColumn("revised_score", revised("score")).withColumn("loss_type", F.lit("point-wise"))
    text, held = split_queries(evidence.withColumn("loss_type", loss_type()), "query", dev, seed)
    return point, text, held


def final_sets(corpora: list[tuple[DataFrame, DataFrame]], dev: int = 250, seed: str = "final") -> dict[str, DataFrame]:
    """sft, point_wise and dev of two corpora of (evidence rows, distilled pairs).

    Distilled pairs are for training only. Dev rows come from the evidence of each corpus; the larger of both is cut to the
    smaller one's size, in the order of a hash of query and document (rows that share both are told apart by nothing else).
    """
    parts = [marked(evidence, distilled, dev, f"{seed}{k}") for k, (evidence, distilled) in enumerate(corpora)]
    point, text, held = (parts[0][i].unionByName(parts[1][i], allowMissingColumns=True) for i in range(3))
    devs = parts[0][2].withColumn("_part", F.lit(0)).unionByName(parts[1][2].withColumn("_part", F.lit(1)), allowMissingColumns=True)
    devs = devs.withColumn("_key", F.concat_ws("\n", F.coalesce("query", F.lit("")), F.coalesce("document", F.lit(""))))
    least = devs.agg(F.least(F.count_if(F.col("_part") == 0), F.count_if(F.col("_part") == 1)).alias("cap"))  # no rows of a corpus: no dev rows
    caps = F.broadcast(devs.sparkSession.createDataFrame([(0,), (1,)], "_part int").crossJoin(F.broadcast(least)))  # two rows
    return {"sft": text, "point_wise": point, "dev": first_of_groups(devs, ["_part"], "_key", seed, caps).drop("_part", "_key")}


def heldout(pairs: DataFrame, evidence: DataFrame, query: str, n: int, seed: str, key: str | None = None) -> DataFrame:
    """The first ``n`` pairs whose query isn't in the evidence set, in hash order of the query and then by ``key`` (or all columns)."""
    rest = pairs.join(evidence.select(query).distinct(), query, "left_anti")
    return rest.orderBy(seeded(seed, query), query, *([key] if key else sorted(set(pairs.columns) - {query}))).limit(n)
