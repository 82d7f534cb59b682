"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned against every training document.

Words are runs of a-z (after lower-casing A-Z), 0-9 and non-ASCII characters. A benchmark item of ``window`` words or more
gives all its windows of that many consecutive words; a shorter one, if it has words, is one window. A worker turns words
into ids of the benchmark's own vocabulary, so a place can only start a window when none of its words is foreign; the
remaining places are hashed, looked up, and each hit is verified word by word.

The benchmark is cut into blocks of at most BLOCK_BYTES of text (or one item), each broadcast by itself; one block is usual. A
worker holds one block at a time, as flat arrays: its texts as word ids, and for each window a hash and a place (some 20 bytes a
word, and its vocabulary). One block is built once a process. With more, whose broadcasts add up to the benchmark's size, a
worker gathers GATHER_BYTES of documents and takes them through one block after the other.

Null text has no words and no hits; an empty benchmark hits nothing; items with null id or text take no part; repeated rows
are judged alike; windows that several items share count for each; a very long text is scanned whole, in memory that grows with
its own words. ``remove`` returns whole rows with whatever columns they have.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, map_batches

WINDOW, SHARE = 13, 20
#: Bytes of benchmark text in one broadcast block, and of documents that go through several blocks at a time.
BLOCK_BYTES, GATHER_BYTES = 16 << 20, 32 << 20
FACTOR = 0x9E3779B97F4A7C15
#: ASCII bytes that belong to no word become spaces; capitals become small letters.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class Windows:
    """The windows of some benchmark items: all items' word ids in one array, and the windows' places in it by hash."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        ids, self.names, starts = array("i"), [], [0]
        learn = self.vocabulary
        for item, text in items:
            words = words_of(text)
            ids.extend([learn.setdefault(w, len(learn) + 1) for w in words])
            if words:
                self.names.append(str(item))
                starts.append(len(ids))
        self.flat, self.starts = np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32), np.array(starts, np.int64)
        sizes = np.diff(self.starts)
        self.tables = []
        for n in sorted(set(np.minimum(sizes, window).tolist())):
            # every place of a window of this length: the whole of a short item, or all places of a longer one
            first = self.starts[:-1][np.minimum(sizes, window) == n]
            many = sizes[np.minimum(sizes, window) == n] - n + 1
            ends = np.cumsum(many)
            places = (np.arange(ends[-1]) + np.repeat(first - ends + many, many)).astype(np.int32)
            factors = np.cumprod(np.full(n, FACTOR, np.uint64))
            hashes = np.zeros(len(places), np.uint64)
            for j in range(n):
                hashes += self.flat[places + j].astype(np.uint64) * factors[j]
            order = np.argsort(hashes, kind="stable")
            hashes, places = hashes[order], places[order]
            owner = np.searchsorted(self.starts, places, "right")
            again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])  # a window that its item holds several times
            for j in range(n):
                again &= self.flat[places[1:] + j] == self.flat[places[:-1] + j]
            kept = np.concatenate([[True], ~again])
            self.tables.append((n, factors, hashes[kept], places[kept]))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """A mask of the words inside occurring windows (None: no window occurs), and the items that own them."""
        if not words or not self.tables:
            return None, set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        foreign = np.concatenate([[0], np.cumsum(ids == 0)])
        edges, items = None, set()
        for n, factors, hashes, places in self.tables:
            if n > len(words):
                continue
            at = np.flatnonzero(foreign[n:] == foreign[:-n])
            if not len(at):
                continue
            key = np.zeros(len(at), np.uint64)
            for j in range(n):
                key += ids[at + j].astype(np.uint64) * factors[j]
            low = np.searchsorted(hashes, key)
            there = hashes[np.minimum(low, len(hashes) - 1)] == key
            at, key, low = at[there], key[there], low[there]
            if not len(at):
                continue
            # one look at each hash that the document has: its first place in the document against all of the benchmark's
            _, once, which = np.unique(key, return_index=True, return_inverse=True)
            held = np.zeros(len(once), bool)
            for u, k in enumerate(once.tolist()):
                shown = ids[at[k] : at[k] + n]
                mine = places[low[k] : np.searchsorted(hashes, key[k], "right")]
                same = (self.flat[mine[:, None] + np.arange(n)] == shown).all(axis=1)  # verified word by word
                if same.any():
                    held[u] = True
                    items.update(self.names[i] for i in np.unique(np.searchsorted(self.starts, mine[same], "right") - 1).tolist())
            # other places with the hash of a verified one are compared with that one
            good = held[which]
            for j in range(n):
                good &= ids[at + j] == ids[at[once[which]] + j]
            odd = np.flatnonzero(~good)
            for k in odd.tolist():  # another window under the same hash
                mine = places[low[k] : np.searchsorted(hashes, key[k], "right")]
                same = (self.flat[mine[:, None] + np.arange(n)] == ids[at[k] : at[k] + n]).all(axis=1)
                if same.any():
                    good[k] = True
                    items.update(self.names[i] for i in np.unique(np.searchsorted(self.starts, mine[same], "right") - 1).tolist())
            at = at[good]
            if len(at):
                edges = np.zeros(len(words) + 1, np.int64) if edges is None else edges
                np.add.at(edges, at, 1)
                np.add.at(edges, at + n, -1)
        return None if edges is None else np.cumsum(edges[:-1]) > 0, items


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast blocks of (item_id, text), each of at most ``block_bytes`` of text or one item."""
    sc = benchmark.sparkSession.sparkContext
    out, part, size = [], [], 0
    rows = benchmark.selectExpr("cast(item_id as string) item_id", "cast(text as string) text").where("item_id is not null and text is not null")
    for r in rows.toLocalIterator():  # a partition at a time; only one block is held
        more = len(r["text"].encode())
        if part and size + more > block_bytes:
            out.append(sc.broadcast(part))
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += more
    return [*out, sc.broadcast(part)] if part else out


#: The block that this process has built last.
_built: dict = {}


def built(part, window: int) -> Windows:
    """A broadcast block's windows, made once while this process goes on with the same block."""
    key = (part._jbroadcast.id() if getattr(part, "_jbroadcast", None) is not None else getattr(part, "_path", None) or id(part), window)
    if _built.get("key") != key:
        _built.clear()
        _built.update(windows=Windows(part.value, window), key=key)
    return _built["windows"]


def gathered(batches, column: int, some: int):
    """Lists of record batches with about GATHER_BYTES of text where there are several blocks, else one by one."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if some < 2 or size >= GATHER_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def scanned(parts: list, window: int, batches: list, column: int) -> list[list[tuple[np.ndarray | None, set[str], int]]]:
    """For each batch, each text's mask, items and number of words, through all blocks."""
    if not parts:
        return [[(None, set(), len(words_of(t))) for t in b.column(column).to_pylist()] for b in batches]
    found: list = [[None] * b.num_rows for b in batches]
    for part in parts:
        one = built(part, window)
        if getattr(part, "_path", None):
            vars(part).pop("_value", None)  # its texts aren't needed any more, and can be read again
        for mine, b in zip(found, batches):
            for k, text in enumerate(b.column(column).to_pylist()):
                words = words_of(text)
                mask, items = one.scan(words)
                if mine[k] is not None and mine[k][0] is not None:
                    mask = mine[k][0] if mask is None else mask | mine[k][0]
                mine[k] = (mask, items if mine[k] is None else items | mine[k][1], len(words))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    parts = blocks(benchmark)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def run(batches):
        for some in gathered(batches, 1, len(parts)):
            for b, found in zip(some, scanned(parts, window, some, 1)):
                hits, sizes = [0 if mask is None else int(mask.sum()) for mask, _, _ in found], [n for _, _, n in found]
                yield batch(
                    schema,
                    doc_id=b.column(0),
                    n_words=sizes,
                    n_hit=hits,
                    n_items=[len(items) for _, items, _ in found],
                    items_sha256=[hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() for _, items, _ in found],
                    contaminated=[n > 0 and share * n >= size for n, size in zip(hits, sizes)],
                )

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return map_batches(rows, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_spans(text: str, mask: np.ndarray) -> str:
    """The text without the masked words and what stands between two masked ones."""
    raw = text.encode()
    flat, at, spans = raw.translate(WORD_BYTES), 0, []
    for k, word in enumerate(flat.split()):
        start = flat.index(word, at)
        at = start + len(word)
        if mask[k]:
            if k and mask[k - 1]:
                spans[-1][1] = at
            else:
                spans.append([start, at])
    kept, at = [], 0
    for start, end in spans:
        kept.append(raw[at:start])
        at = end
    return b"".join([*kept, raw[at:]]).decode()


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, share: int = SHARE, text: str = "text") -> DataFrame:
    """Whole rows without contaminated documents ("documents"), or all rows without the hit spans ("spans")."""
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    parts, column = blocks(benchmark), docs.columns.index(text)

    def run(batches):
        for some in gathered(batches, column, len(parts)):
            for b, found in zip(some, scanned(parts, window, some, column)):
                if mode == "documents":
                    yield b.filter(pa.array([mask is None or share * int(mask.sum()) < n for mask, _, n in found], pa.bool_()))
                else:
                    clean = [t if mask is None else without_spans(t, mask) for t, (mask, _, _) in zip(b.column(column).to_pylist(), found)]
                    yield b.set_column(column, b.schema.field(column), pa.array(clean, b.schema.field(column).type))

    return map_batches(docs, run, docs.schema)
