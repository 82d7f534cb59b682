"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its features; a softmax over two classes reads the average. Features,
all hashed in one table: each word, each word's character n-grams (with marked ends), and a mark wherever a word repeats
the one before it (the part of a word bigram that carries over to unseen words). Vectors and output are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows; the sample is balanced and the output's bias is
then moved to the classes' true shares. Scoring reads every whole text: a worker folds vectors and output into two numbers
for each word and remembers them.

Null and empty texts have no features and get the classes' prior; without training rows every score is 0.5 and without rows
of one class the smoothed prior; repeated rows score alike; only id, text and, for fitting, labels are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordRows, batch, held, labelled_sample, logistic, map_batches

#: Documents of each class that are fitted at most, and the longest that is.
FIT_DOCS, FIT_CHARS = 3_000, 60_000
BUCKETS, DIM, GRAMS, EPOCHS, RATE, REPEAT = 1 << 17, 8, (2, 3, 4), 4, 0.6, 4.0


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all the words' features and the word (its number) that each belongs to."""
    marked = [f"<{w}>".encode() for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(owner))  # bytes to the word's end
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
    ids, owners = [np.fromiter(map(zlib.crc32, marked), np.int64, len(marked)) % BUCKETS], [np.arange(len(marked))]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        key = np.full(len(at), n, np.uint64)
        for j in range(n):
            key = key * np.uint64(257) + data[at + j]
        key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        ids.append((key % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[at])
    return np.concatenate(ids), np.concatenate(owners)


@dataclass
class Model:
    vectors: np.ndarray  # [BUCKETS + 1, DIM]; the last is the repeat mark's
    output: np.ndarray  # [DIM, 2]
    bias: np.ndarray

    def folded(self) -> np.ndarray:
        return (self.vectors @ self.output).astype(np.float32)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct features and their shares of it."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    counts = Counter(words)
    ids, owners = features(list(counts))
    weights = np.fromiter(counts.values(), np.float64, len(counts))[owners]
    again = sum(map(str.__eq__, words, words[1:]))
    ids, weights = np.append(ids, BUCKETS), np.append(weights, REPEAT * again)
    distinct, back = np.unique(ids, return_inverse=True)
    weights = np.bincount(back, weights)
    return distinct, (weights / weights.sum()).astype(np.float32)


def fit(sample: list[tuple[int, str, int]], shares: tuple[int, int], seed: int = 7) -> Model:
    """A model from (doc_id, text, label); ``shares`` are the classes' sizes among all training rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5 / DIM, 0.5 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    output, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    prior = np.log((np.array(shares) + 1) / (sum(shares) + 2))
    labels = np.array([y for _, _, y in sample])
    if len(set(labels.tolist())) < 2:
        return Model(vectors, output, prior)
    bags = [bag(text) for _, text, _ in sample]
    step, steps = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            ids, w = bags[k]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = w @ vectors[ids]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            # an average spreads its gradient thin: each vector moves by its share, scaled up by the features' number
            vectors[ids] -= (rate * min(len(ids), 1000) ** 0.5) * np.outer(w, back)
    seen = np.bincount(labels, minlength=2) + 1
    return Model(vectors, output, bias + prior - np.log(seen / seen.sum()))


class Scorer:
    def __init__(self, folded: np.ndarray, bias: np.ndarray):
        self.folded, self.bias = folded, bias
        self.rows = WordRows(self.sums, 3)

    def sums(self, words: list[str]) -> np.ndarray:
        """For each word, the sum of its features' two numbers, and how many they are."""
        ids, owners = features(words)
        n = len(words)
        return np.stack([np.bincount(owners, self.folded[ids, 0], n), np.bincount(owners, self.folded[ids, 1], n), np.bincount(owners, minlength=n)], axis=1)

    def scores(self, texts: list[str | None]) -> list[float]:
        """Scores of a batch; its words are looked up STEP at a time, whatever the lengths of the texts."""
        cut = [t.split() if t else [] for t in texts]
        totals, again = np.zeros((len(cut), 3)), np.zeros(len(cut))
        words, owners, last = [], [], [None] * len(cut)

        def settle():
            at, of = self.rows.at(words), np.repeat([d for d, _ in owners], [n for _, n in owners])
            for c in range(3):
                totals[:, c] += np.bincount(of, self.rows.matrix[at, c], len(cut))
            same = (at[1:] == at[:-1]) & (of[1:] == of[:-1])
            again[:] += np.bincount(of[1:][same], minlength=len(cut))
            words.clear()
            owners.clear()

        for d, mine in enumerate(cut):
            k = 0
            while k < len(mine):
                part = mine[k : k + self.rows.STEP - len(words)]
                if k:  # the rest of a text that was cut
                    again[d] += part[0] == last[d]
                words += part
                owners.append((d, len(part)))
                last[d] = part[-1]
                k += len(part)
                if len(words) >= self.rows.STEP:
                    settle()
        if words:
            settle()
        totals += again[:, None] * np.append(REPEAT * self.folded[BUCKETS], REPEAT)
        logits = self.bias + totals[:, :2] / np.maximum(totals[:, 2:], 1e-9)
        return logistic(logits[:, 1] - logits[:, 0]).tolist()


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, label: str = "quality") -> Model:
    known = labels.where(~held("doc_id", mod, rest) & F.col(label).isin(0, 1)).groupBy(F.col(label).alias("label")).count().collect()
    shares = {r["label"]: r["count"] for r in known}
    return fit(labelled_sample(docs, labels, label, mod, rest, FIT_DOCS, FIT_CHARS), (shares.get(0, 0), shares.get(1, 0)))


def scores(docs: DataFrame, model: Model, mod: int = 5, rest: int = 0, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.folded(), model.bias))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        scorer = Scorer(*shared.value)
        for b in batches:
            found = scorer.scores(b.column(2).to_pylist())
            yield batch(schema, doc_id=b.column(0), held_out=b.column(1), score=found, predicted=[int(x >= least) for x in found])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held("doc_id", mod, rest).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """Whole rows of documents that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast((model.folded(), model.bias))
    column = docs.columns.index(text)

    def run(batches):
        scorer = Scorer(*shared.value)
        for b in batches:
            yield b.filter(pa.array([x >= least for x in scorer.scores(b.column(column).to_pylist())], pa.bool_()))

    return map_batches(docs, run, docs.schema)
