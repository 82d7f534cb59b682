"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams (one to three characters, word ends marked) in order. A
document's own n-grams are ordered the same way, and its distance to a profile is the sum, over its most frequent n-grams, of
how far out of place each is; one that the profile lacks counts as the profile's whole length. The nearest profile wins.
Letters are what Unicode calls letters; numbers of any kind, marks and signs only part words.

Profiles are learned from a bounded sample of each language: the FIT_DOCS different texts with the smallest hashes, whole,
whatever their lengths. Their n-grams are counted by the executors; the driver sees the profiles alone, RANKS n-grams for each
language, and their number is the number of languages in the table. Scoring reads every whole text, a document's n-grams are
counted exactly, and ties of counts, in profiles and documents, are ordered by the n-gram's characters. A worker remembers the
n-grams of words; beside that it holds one Arrow batch and the distinct words and n-grams of one document.

A null text, or one without a letter, gets ``und`` with score 0; ties go to the alphabetically first language; with no
training rows everything is ``und``. Repeated rows are judged alike; only id, text and, for fitting, lang are read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Cache, batch, held, map_batches, materialize

#: Documents of each language that are fitted; n-grams in a profile; words that a worker remembers; different words it counts at a time.
FIT_DOCS, RANKS, CACHED, COUNTED = 1_500, 400, 100_000, 200_000
#: What ``keep`` asks of a text with at least SURE different n-grams: this share of the way from no n-gram in place to all.
LEAST_FIT, SURE = 0.2, 100
#: Runs of letters and of numbers that aren't decimal digits (such as fractions); the latter are rare and taken out afterwards.
WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in small letters."""
    found = WORDS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def grams(word: str) -> list[str]:
    marked = f"_{word}_"
    return [g for n in (1, 2, 3) for k in range(len(marked) - n + 1) if (g := marked[k : k + n]) != "_"]


def packed(gram: str) -> int:
    """An n-gram as one number: 21 bits a character, exact."""
    key = 0
    for c in gram:
        key = key << 21 | ord(c)
    return key


class Profiles:
    """Each language's n-grams in order, turned around: for an n-gram, the languages that have it and where."""

    def __init__(self, ranked: dict[str, list[str]]):
        self.names = sorted(ranked)
        rows = sorted((packed(g), j, rank) for j, name in enumerate(self.names) for rank, g in enumerate(ranked[name]))
        keys = np.array([k for k, _, _ in rows], np.uint64)
        self.keys, self.starts = np.unique(keys, return_index=True)
        self.counts = np.diff(np.append(self.starts, len(keys)))
        self.langs, self.ranks = np.array([j for _, j, _ in rows], np.int64), np.array([r for _, _, r in rows], np.int64)
        self.cache = Cache(None, CACHED)

    def learn(self, pieces: list[str]) -> None:
        """The n-grams of every run of letters in each piece, all pieces at once."""
        runs = [words_of(p) for p in pieces]
        words = [w for found in runs for w in found]
        piece_of = np.repeat(np.arange(len(pieces)), [len(found) for found in runs])
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        if words:
            codes = np.frombuffer(("_" + "_".join(words) + "_").encode("utf-32-le"), np.uint32).astype(np.uint64)
            mark = codes == ord("_")  # no run of letters holds one
            word_at = np.minimum(np.cumsum(mark) - 1, len(words) - 1)  # a mark counts with the word behind it
            for n in (1, 2, 3):
                key = np.zeros(len(codes) - n + 1, np.uint64)
                for k in range(n):
                    key = (key << np.uint64(21)) | codes[k : len(codes) - n + 1 + k]
                inside = ~mark if n == 1 else np.ones(len(key), bool) if n == 2 else ~mark[1:-1]
                keys.append(key[inside])
                owners.append(piece_of[word_at[: len(inside)][inside]])
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        keys = keys[np.argsort(owners, kind="stable")]
        ends = np.cumsum(np.bincount(owners, minlength=len(pieces))).tolist() if pieces else []
        first = 0
        for piece, end in zip(pieces, ends):
            self.cache[piece] = keys[first:end].copy()
            first = end

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
        """For each text the nearest language, how clearly it is nearer than the next (0 to 1), how well it fits, and n-grams."""
        cut = [Counter(t.split()) if t else {} for t in texts]
        self.cache.trim()
        fresh = set().union(*cut) - self.cache.keys()
        for piece in [p for p in fresh if p in self.cache.old]:
            self.cache[piece] = self.cache.old[piece]
            fresh.discard(piece)
        fresh = list(fresh)
        for k in range(0, len(fresh), 1 << 15):
            self.learn(fresh[k : k + (1 << 15)])
        return [self.nearest(c) for c in cut]

    def ordered(self, pieces: dict[str, int]) -> np.ndarray:
        """The RANKS most frequent n-grams of a document's pieces, most frequent first, ties by key."""
        arrays = list(map(self.cache.__getitem__, pieces))
        sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
        if not sizes.any():
            return np.zeros(0, np.uint64)
        keys = np.concatenate(arrays)
        at = np.argsort(keys)
        keys, weights = keys[at], np.repeat(np.fromiter(pieces.values(), np.int64, len(pieces)), sizes)[at]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.add.reduceat(weights, first)
        return keys[first[np.argsort(-counts, kind="stable")[:RANKS]]]

    def distances(self, order: np.ndarray) -> np.ndarray:
        """How far ``order`` is out of place for each language."""
        apart = np.full(len(self.names), RANKS * len(order), np.int64)
        at = np.minimum(np.searchsorted(self.keys, order), len(self.keys) - 1)
        place = np.flatnonzero(self.keys[at] == order)
        many = self.counts[at[place]]
        ends = np.cumsum(many)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at[place]] - ends + many, many)
        gain = RANKS - np.abs(self.ranks[entry] - np.repeat(place, many))
        return apart - np.bincount(self.langs[entry], np.maximum(gain, 0), len(apart)).astype(np.int64)

    def nearest(self, pieces: dict[str, int]) -> tuple[str, float, float, int]:
        order = self.ordered(pieces)
        if not len(order):
            return "und", 0.0, 0.0, 0
        if not self.names:
            return "und", 0.0, 1.0, len(order)
        apart = self.distances(order)
        best = int(apart.argmin())
        fit = 1.0 - float(apart[best]) / (RANKS * len(order))
        rest = np.delete(apart, best)
        both = float(apart[best] + rest.min()) if len(rest) else 0.0
        score = fit if not len(rest) else 1 - float(apart[best]) / both if both else 1.0
        return self.names[best], score, fit, len(order)


def sample(docs: DataFrame, mod: int, rest: int) -> DataFrame:
    """lang, text: FIT_DOCS different texts of each language at most, those with the smallest hashes.

    Texts are told apart by 64-bit hashes. The cuts are found on hashes alone, about twice as many as are wanted.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held("doc_id", mod, rest)).select("lang", "text", F.xxhash64("text").alias("rank"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("rank", 0.05).alias("n"))
    bound = sizes.select(F.col("lang").alias("of"), (F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(2.0 * FIT_DOCS) / F.greatest(F.col("n"), F.lit(1))) - 2.0**63).alias("bound"))
    near = rows.select("lang", "rank").join(F.broadcast(bound), F.col("lang") == F.col("of")).where(F.col("rank") <= F.col("bound")).select("lang", "rank").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    cuts = near.withColumn("nth", nth).where(F.col("nth") <= FIT_DOCS).groupBy(F.col("lang").alias("of")).agg(F.max("rank").alias("cut"))
    cuts = materialize(cuts)  # a row for each language
    return rows.join(F.broadcast(cuts), F.col("lang") == F.col("of")).where(F.col("rank") <= F.col("cut")).groupBy("lang", "rank").agg(F.first("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, mod: int = 4, rest: int = 2) -> Profiles:
    """Profiles from a sample of the rows of ``docs`` that have a language and aren't held out."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def flush(words: dict[str, Counter]):
        for lang, seen in words.items():
            counts: Counter = Counter()
            for word, n in seen.items():
                for g in grams(word):
                    counts[g] += n
            shown = list(counts)
            for k in range(0, len(shown), 1 << 16):
                some = shown[k : k + (1 << 16)]
                yield batch(schema, lang=[lang] * len(some), gram=some, n=[counts[g] for g in some])

    def count(batches):
        words: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, words.values())) > COUNTED:
                yield from flush(words)
                words = {}
        yield from flush(words)

    summed = map_batches(sample(docs, mod, rest), count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # by UTF-32 order, which for strings of code points is that of their UTF-8 bytes; only RANKS rows a language leave a task
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram").cast("binary")))
    ranked: dict[str, list[str]] = {}
    for r in sorted(summed.withColumn("nth", nth).where(F.col("nth") <= RANKS).select("lang", "nth", "gram").collect()):
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked)


def predict(docs: DataFrame, profiles: Profiles, mod: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        mine = shared.value
        for b in batches:
            found = mine.judge(b.column(2).to_pylist())
            yield batch(schema, doc_id=b.column(0), held_out=b.column(1), lang_pred=[x[0] for x in found], score=[x[1] for x in found])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held("doc_id", mod, rest).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, profiles: Profiles, languages: list[str] | None = None, least: float = LEAST_FIT, text: str = "text") -> DataFrame:
    """Whole rows of documents that are in a language: one of ``languages`` (None: any learned one), and that it fits them.

    A text without a letter goes. One with SURE different n-grams or more goes if the nearest profile fits it less than
    ``least``: it is in a language that was not learned, or in none; shorter ones say too little to be rejected for that.
    Where no profile could be learned, all texts with a letter stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    column = docs.columns.index(text)
    wanted = None if languages is None else set(languages)

    def run(batches):
        mine = shared.value

        def good(lang: str, fit: float, grams: int) -> bool:
            if not grams or not mine.names:
                return bool(grams)
            return (wanted is None or lang in wanted) and (grams < SURE or fit >= least)

        for b in batches:
            yield b.filter(pa.array([good(lang, fit, n) for lang, _, fit, n in mine.judge(b.column(column).to_pylist())], pa.bool_()))

    return map_batches(docs, run, docs.schema)
