"""Token counts by a map-side two-tier lookup.

A pre-token here is a run of non-space characters, as the tokenizer's own pattern never joins across space. Tier one is a
compact table of the frequent pre-tokens' lengths, broadcast to every worker: it is found by a first pass in which each
task keeps a bounded Misra-Gries summary of its pre-tokens, and the summaries (never the pre-tokens themselves) are
merged. Tier two is a bounded cache in each worker, filled by encoding what tier one misses. The table only saves work:
every count is exact whatever it holds.

Null text counts as empty (0 bytes, 0 tokens); a text with one of the control characters U+001C to U+001F, which Python
and the tokenizer class differently, is encoded whole; repeated rows are counted alike; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_table
from .common import batch, map_batches

#: Entries of a task's summary while it reads and as it leaves, of the broadcast table, and of one worker cache generation.
SUMMARY, SENT, TABLE, CACHED = 200_000, 2_000, 50_000, 250_000
#: Longer pre-tokens are never remembered.
LONGEST = 128
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: The lower-casing tokenizer's own way of cutting text, and the same cut for lower-cased Latin-1.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
LETTERS, NUMBERS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")


class Lengths(dict):
    """Pre-tokens to token counts: the frequent table first, then this worker's two cache generations, then the tokenizer."""

    def __init__(self, table: dict[str, int], make, cap: int):
        super().__init__()
        self.table, self.make, self.cap, self.old = table, make, cap, {}

    def __missing__(self, word: str) -> int:
        n = self.table.get(word)
        if n is None:
            n = self.old.get(word)
        if n is None:
            n = self.make(word)
        if len(word) <= LONGEST:
            self[word] = n
        return n

    def trim(self) -> None:
        if len(self) > self.cap:
            self.old = dict(self)
            self.clear()


class Counts:
    """Token counts by one tokenizer, with the frequent table as tier one and a bounded cache as tier two."""

    def __init__(self, spec: str, words: list[str] = (), lengths: bytes = b""):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.bytes = self.tokenizer.model, byte_table()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(spec)
        # the short way below holds for this shape of tokenizer only; any other is asked for every miss
        self.short = parts["normalizer"] == NORMALIZER and parts["pre_tokenizer"] == PRE_TOKENIZER
        self.lengths = Lengths(dict(zip(words, lengths)), self.length, CACHED)
        self.parts = Lengths({}, self.part, CACHED)

    def part(self, part: str) -> int:
        return len(self.model.tokenize("".join([self.bytes[b] for b in part.encode()])))

    def length(self, word: str) -> int:
        """A miss: Latin-1 words are cut and lower-cased here, so that words which differ in case or stops share their parts."""
        if self.short and max(word) < "\u0100" and not any(s in word for s in self.special):
            return sum(map(self.parts.__getitem__, PARTS.findall(word.lower())))
        return len(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def count(self, texts: list[str]) -> list[int]:
        found = []
        for text in texts:
            self.lengths.trim()
            self.parts.trim()
            if any(c in text for c in ODD):
                found.append(len(self.tokenizer.encode(text, add_special_tokens=False).ids))
            else:
                found.append(sum(map(self.lengths.__getitem__, text.split())))
        return found


def frequent(docs: DataFrame, table: int = TABLE) -> list[str]:
    """At most ``table`` pre-tokens that are frequent in all texts, by merged bounded summaries."""

    def summarize(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    seen.update(text.split())
            if len(seen) > SUMMARY:  # Misra-Gries: subtract the count that leaves half the entries
                floor = int(np.partition(np.fromiter(seen.values(), np.int64, len(seen)), len(seen) // 2)[len(seen) // 2])
                seen = Counter({w: n - floor for w, n in seen.items() if n > floor})
        top = [(w, n) for w, n in seen.most_common(SENT) if len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    rows = map_batches(docs.selectExpr("cast(text as string) text"), summarize, "word string, n long")
    return [r["word"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(table).collect()]


_COUNTS: dict[bytes, Counts] = {}


def counts(docs: DataFrame, spec: str, limit: int = 2048, table: int = TABLE) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every whole text."""
    words = frequent(docs, table)
    counter = Counts(spec)
    lengths = [counter.length(w) for w in words]
    words, lengths = [w for w, n in zip(words, lengths) if n < 256], bytes(n for n in lengths if n < 256)
    packed = ("\n".join(words), lengths, spec, hashlib.sha256(("\n".join(words) + spec).encode()).digest())
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # at most TABLE words of at most LONGEST characters
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        text, sizes, given, key = shared.value
        if key not in _COUNTS:
            _COUNTS.clear()
            _COUNTS[key] = Counts(given, text.split("\n") if text else [], sizes)
        mine = _COUNTS[key]
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = mine.count(texts)
            yield batch(schema, doc_id=b.column(0), n_bytes=[len(t.encode()) for t in texts], n_tokens=n, over_limit=[x > limit for x in n])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
