"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file lists byte sequences and their merge ranks. The library works on characters, so every byte stands for one
printable character, every way of splitting a listed sequence in two listed parts becomes a merge (in rank order), and a
whole match that is itself listed is taken as it is. Decoding reverses the byte table; a character whose bytes are split
over tokens comes back whole when the bytes are joined.

A worker encodes each distinct piece of a batch once: a piece is a run of non-space characters with the space before it,
or a run of spaces, so no match of the split pattern crosses a piece's end. Rows: null text counts as empty, empty text has
no tokens, repeated rows are encoded alike, and other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Cache, batch, map_batches

#: The characters with the Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Pieces that a worker remembers in one generation, and the longest it remembers.
CACHED, LONGEST = 250_000, 256
#: A rank file larger than this isn't shipped inside a closure.
MAX_VOCABULARY_BYTES = 64 << 20


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the rest for U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        chars = byte_table()
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        shown = {token: "".join([chars[b] for b in token]) for token in known}
        merges = [(shown[token[:i]], shown[token[i:]]) for token in sorted(known, key=known.get) for i in range(1, len(token)) if token[:i] in known and token[i:] in known]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in known.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = {rank: bytes([back[c] for c in shown[token]]) for token, rank in known.items()}
        self.cache = Cache(None, CACHED)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [PIECES.findall(t) for t in texts]
        cache = self.cache
        cache.trim()
        fresh = set(chain.from_iterable(cut)) - cache.keys()
        for piece in [p for p in fresh if p in cache.old]:
            cache[piece] = cache.old[piece]
            fresh.discard(piece)
        fresh = list(fresh)
        long = {}
        for k in range(0, len(fresh), 4096):
            part = fresh[k : k + 4096]
            for piece, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                (cache if len(piece) <= LONGEST else long)[piece] = np.asarray(got.ids, "<u4").tobytes()
        if long:
            return [b"".join([cache[p] if p in cache else long[p] for p in pieces]) for pieces in cut]
        return [b"".join(map(cache.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids; an unknown id raises KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and for each the first and the last-plus-one character it touches; parts of one character share it."""
        got = self.tokenizer.encode(text, add_special_tokens=False)
        return got.ids, got.offsets

    def pieces(self, ids: list[int]) -> list[str]:
        """Text by token: a character split over tokens shows with the token that completes it, broken bytes as U+FFFD."""
        import codecs

        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.bytes_of[i], k == len(ids) - 1) for k, i in enumerate(ids)]


_CODECS: dict[tuple[bytes, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec for each rank file and pattern in a process."""
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def load_ranks(path: str) -> bytes:
    """A rank file's bytes, checked against the size that may be broadcast."""
    with open(path, "rb") as file:
        ranks = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return ranks


def encode(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (packed little-endian unsigned 32-bit) of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text)

    def run(batches):
        coder, schema = codec(shared.value, pattern), None
        for b in batches:
            schema = schema or pa.schema([b.schema.field(0).with_name("key"), ("ids", pa.binary())])
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coder.encode(texts), pa.binary())], schema=schema)

    return map_batches(rows, run, f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode(rows: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``data``, the bytes of packed ids; null ids give null data."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        coder, schema = codec(shared.value, pattern), None
        for b in batches:
            schema = schema or pa.schema([b.schema.field(0).with_name("key"), ("data", pa.binary())])
            data = [None if x is None else coder.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], schema=schema)

    return map_batches(rows.select(key, ids), run, f"key {kind}, data binary").withColumnRenamed("key", key)


def digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text: encoded, then decoded from the ids alone."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        coder = codec(shared.value, pattern)
        for b in batches:
            ids = coder.encode([t or "" for t in b.column(1).to_pylist()])
            yield batch(
                schema,
                doc_id=b.column(0),
                n_tokens=[len(x) // 4 for x in ids],
                ids_sha256=[hashlib.sha256(x).hexdigest() for x in ids],
                decoded_sha256=[hashlib.sha256(coder.decode(x)).hexdigest() for x in ids],
            )

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return map_batches(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
