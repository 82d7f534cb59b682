"""Toxic passages by maximum-scoring segment search.

Every token has a log-odds score: how much more often it, or a prefix of it, occurs in toxic than in other training
documents, with an informative Dirichlet prior (the corpus frequencies) that shrinks rare ones. What is not significant
scores a small negative drift, so a segment's score falls unless toxic tokens keep it up. A linear-time scan (Ruzzo and
Tompa) finds all maximal segments of a document. Scores of segments that arise by chance follow an extreme-value law: lambda
solves E[exp(lambda * score)] = 1 over the tokens of non-toxic training documents and K is matched to their segments. A
document's surprise is -log10 of the chance (the sum statistic of Karlin and Altschul) of its r best segments together, at
the best r; a logistic fit turns surprise into a probability.

Fitting uses a bounded, hash-chosen sample of labelled rows; scoring reads whole texts. Null and empty texts hold no segment
and get the smoothed share of toxic documents among those without surprise; without training rows of both labels no token
scores. Repeated rows score alike; only id, text and, for fitting, labels are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from math import lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, batch, held, labelled_sample, logistic, map_batches
from .decontam import WORD_BYTES

FIT_DOCS, FIT_CHARS = 3_000, 60_000
#: Significance of a token, prior's share of the counts, drift, prefix lengths, entries of the table, chance of a passage.
SIGNIFICANT, PRIOR, DRIFT, PREFIXES, TABLE, CHANCE = 4.7, 0.01, 0.3, (4, 5, 6, 7), 65_536, 1e-3
#: Occurrences of a token that one training document witnesses; segments in the sum statistic; the largest surprise.
WITNESS, BEST, MOST = 10, 32, 60.0


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(WORD_BYTES).split() if text else []


def parts(token: bytes) -> list[bytes]:
    """The token and its proper prefixes; a prefix ends with a mark."""
    return [token, *(token[:n] + b"~" for n in PREFIXES if n < len(token))]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time; zeros and negatives only extend."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, cumulative score before and at the end
    for k in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = k, k + 1, float(total[k]), float(total[k + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                stack.append((start, end, low, high))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, high - low) for s, e, low, high in stack]


@dataclass
class Model:
    odds: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    size: float = 1.0  # K
    offset: float = 0.0
    slope: float = 0.0

    def score_token(self, token: bytes) -> float:
        """The highest significant log-odds among the token and its prefixes, less the drift."""
        return max((self.odds[p] for p in parts(token) if p in self.odds), default=0.0) - DRIFT

    def passages(self, words: list[bytes], cache: dict) -> list[tuple[int, int, float]]:
        """The segments with their -log10 chance in a document of this length."""
        scores = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        if not len(scores) or scores.max() <= 0:
            return []
        return [(start, end, float(max(0.0, self.rate * score - np.log(self.size * len(words))) / np.log(10))) for start, end, score in segments(scores)]

    def surprise(self, words: list[bytes], cache: dict) -> float:
        scores = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        if not len(scores) or scores.max() <= 0:
            return 0.0
        found = sorted((x for _, _, x in segments(scores)), reverse=True)[:BEST]
        chance = np.log(self.size * len(words))
        most = total = 0.0
        for r, score in enumerate(found, 1):
            total += self.rate * score - chance
            if total > 0:
                most = max(most, total - (r - 1) * log(total) + lgamma(r + 1) + lgamma(r) - r * log(2) * (r > 1))
        return float(min(MOST, most / log(10)))

    def probability(self, surprise: float) -> float:
        return float(logistic(self.offset + self.slope * surprise))


def log_odds(y1: int, y0: int, n1: int, n0: int) -> float:
    """Log-odds between two corpora, shrunk by a Dirichlet prior with the pooled frequencies and PRIOR of all counts."""
    prior = PRIOR * (y1 + y0)
    rest = PRIOR * (n1 + n0) - prior
    return log((y1 + prior) / (n1 + rest - y1)) - log((y0 + prior) / (n0 + rest - y0))


def significance(y1: int, y0: int, n1: int, n0: int) -> float:
    """Root of twice the log likelihood ratio that y1 of n1 documents is a higher share than y0 of n0; 0 if it is not."""
    if y1 * n0 <= y0 * n1:
        return 0.0
    pooled = (y1 + y0) / (n1 + n0)
    gain = sum(x * log(x / n / p) for x, n, p in ((y1, n1, pooled), (n1 - y1, n1, 1 - pooled), (y0, n0, pooled), (n0 - y0, n0, 1 - pooled)) if x)
    return sqrt(2 * max(gain, 0.0))


def fit(sample: list[tuple[int, str, int]], shares: tuple[int, int]) -> Model:
    texts = {text: y for _, text, y in sample}  # copies are one witness
    cut = [(tokens(text), y) for text, y in texts.items()]
    seen, counts = (Counter(), Counter()), (Counter(), Counter())
    for words, y in cut:
        mine = Counter(p for w in words for p in parts(w))
        seen[y].update(mine.keys())
        counts[y].update({p: min(n, WITNESS) for p, n in mine.items()})
    prior = (shares[1] + 1) / (sum(shares) + 2)
    model = Model(offset=float(np.log(prior / (1 - prior))))
    if not counts[0] or not counts[1]:
        return model
    n1, n0 = sum(counts[1].values()), sum(counts[0].values())
    docs = [sum(y == k for _, y in cut) for k in (1, 0)]
    # what is significant is told by the documents that hold it, how toxic it is by how often they do
    odds = {p: log_odds(counts[1][p], counts[0][p], n1, n0) for p, y1 in seen[1].items() if significance(y1, seen[0][p], *docs) >= SIGNIFICANT}
    model.odds = dict(sorted(((p, x) for p, x in odds.items() if x > DRIFT), key=lambda x: (-seen[1][x[0]], x[0]))[:TABLE])
    cache = Cache(model.score_token, 1 << 30)
    calm = Counter(cache[w] for words, y in cut if not y for w in words)
    for score in {s - DRIFT for s in model.odds.values()}:  # every score could arise by chance
        calm[score] += 0.5 / len(model.odds)
    scores = np.array(list(calm))
    shares_of = np.array(list(calm.values())) / sum(calm.values())
    low, high = 0.0, 50.0
    for _ in range(80):
        model.rate = (low + high) / 2
        low, high = (model.rate, high) if shares_of @ np.exp(np.minimum(model.rate * scores, 600)) < 1 else (low, model.rate)
    model.rate = max(model.rate, 0.05)
    calm_docs = [np.fromiter(map(cache.__getitem__, words), np.float64, len(words)) for words, y in cut if not y and words]
    found = np.array([x for scores in calm_docs if scores.max() > 0 for _, _, x in segments(scores)])
    least = float(np.median(found)) if len(found) else 1.0
    model.size = float(np.clip((np.count_nonzero(found >= least) + 0.5) / (sum(map(len, calm_docs)) * np.exp(-model.rate * least)), 1e-6, 10))
    x = np.array([model.surprise(words, cache) for words, _ in cut])
    y = np.array([y for _, y in cut], float)
    size = np.array([1 + np.sum(y == 0), 1 + np.sum(y == 1)], float)
    weight = np.where(y == 1, prior / (size[1] / size.sum()), (1 - prior) / (size[0] / size.sum()))
    a, b = model.offset, 0.0
    for _ in range(200):  # Newton steps with a little ridge
        p = logistic(a + b * x)
        g = np.array([weight @ (p - y) + 0.01 * a, weight @ ((p - y) * x) + 0.01 * b])
        d = weight * p * (1 - p)
        h = np.array([[d.sum() + 0.01, d @ x], [d @ x, d @ (x * x) + 0.01]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, g)
        move *= min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        a, b = a - move[0], max(0.0, b - move[1])
        if np.abs(move).max() < 1e-7:
            break
    model.offset, model.slope = float(a), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, label: str = "toxic") -> Model:
    known = labels.where(~held("doc_id", mod, rest) & F.col(label).isin(0, 1)).groupBy(F.col(label).alias("label")).count().collect()
    shares = {r["label"]: r["count"] for r in known}
    return fit(labelled_sample(docs, labels, label, mod, rest, FIT_DOCS, FIT_CHARS), (shares.get(0, 0), shares.get(1, 0)))


def scores(docs: DataFrame, model: Model, mod: int = 3, rest: int = 1, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TABLE tokens
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        mine = shared.value
        cache = Cache(mine.score_token, 250_000)
        for b in batches:
            cache.trim()
            found = [mine.probability(mine.surprise(tokens(t), cache)) for t in b.column(2).to_pylist()]
            yield batch(schema, doc_id=b.column(0), held_out=b.column(1), score=found, predicted=[int(x >= least) for x in found])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held("doc_id", mod, rest).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first and last-plus-one word, -log10 chance and words of every significant passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("surprise", pa.float64()), ("words", pa.string())])

    def run(batches):
        mine = shared.value
        cache = Cache(mine.score_token, 250_000)
        for b in batches:
            cache.trim()
            rows = [(i, s, e, x, b" ".join(words[s:e]).decode()) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for words in [tokens(t)] for s, e, x in mine.passages(words, cache) if x >= -np.log10(CHANCE)]
            yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows))))) if rows else batch(schema, **{n: [] for n in schema.names})

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, "doc_id long, start long, end long, surprise double, words string")
