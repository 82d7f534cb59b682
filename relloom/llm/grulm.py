"""Language-model scoring with a gated recurrent network in numpy.

Tokens are lower-cased words and one end for each document. All training tokens are counted; from the counts come the add-one
base score and the network's vocabulary. The output softmax is factored in classes: the VOCABULARY most frequent tokens lie in
classes of equal size by rank, and each has a probability within its class that depends on the state; every other token falls
in a class by its first two characters, where its probability is (count + 1) / (tokens + types + 1) of that class, the one
being for all unknown tokens. So the probabilities of all tokens sum to 1 for any state.

Training: the network starts as the unigram model, is warmed up on the driver with a bounded, hash-chosen sample (FIT_DOCS rows
of at most FIT_TOKENS tokens each), and is then trained by every partition on all its training documents, whatever their
lengths (truncated backpropagation; a gradient in every window, the state carried from one to the next). A step's rate goes
with its share of a full step's tokens, so that the tail of a few long documents doesn't pull the weights its way. The
partitions' weights are averaged by tokens in a tree. Scoring carries the state through each whole document, window after
window, many documents side by side. Texts are cut into words twice: to count them, and to write each document's ids, from
which the network learns and scores.

Null and empty texts are one end token. Without training documents no token is known and every score is 0. Words of equal
counts are ranked in alphabetical order. Repeated rows score alike; only id and text are read. A worker holds the ids of about
GATHER tokens, or of one document if that is longer.
"""

from __future__ import annotations

import threading
from collections import Counter
from heapq import heapify, heapreplace
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, batch, held, map_batches, materialize, scratch

#: Vocabulary classes and their size; classes of the other tokens; state; window; lanes side by side when training and scoring.
CLASSES, SIZE, PREFIXES, STATE, WINDOW, LANES, WIDE = 32, 64, 47, 24, 32, 128, 512
VOCABULARY = CLASSES * SIZE
#: Tokens whose counts are broadcast; documents of the driver's sample and tokens of each at most; epochs over it.
KNOWN, FIT_DOCS, FIT_TOKENS, WARM = 200_000, 400, 20_000, 3
#: Weights that a step moves at a time, which the processor's cache holds; windows whose tokens are laid out at a time.
BLOCK, LAID_OUT = 1 << 14, 16
#: Learning rates of the warm-up and of the pass; full steps after which the latter's is 1 / sqrt(2) of what it was.
WARM_RATE, RATE, HALVING = 0.01, 0.004, 200
#: Tokens that a worker gathers before it runs the network; entries of its caches; models that are summed in one task.
GATHER, CACHED, FAN_IN = 6_000_000, 250_000, 4
END = ""
#: What Python takes for space besides ASCII space.
ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def words_of(text: str | None) -> list[str]:
    """Lower-cased (A-Z) words between ASCII space."""
    if not text:
        return []
    small = text.encode().lower()
    shown = small.decode()
    return [w.decode() for w in small.split()] if any(c in shown for c in ODD_SPACE) else shown.split()


class Vocabulary:
    """Tokens to network ids: rank for the most frequent, VOCABULARY + class for others."""

    def __init__(self, words: list[str], counts: list[int], prefixes: list[str], sizes: list[tuple[int, int]]):
        self.words, self.counts = words, np.array(counts, np.int64)
        self.prefixes = {p: k + 1 for k, p in enumerate(prefixes)}  # class 0 holds all other prefixes
        self.norms = np.array([log10(n + v + 1) for n, v in sizes])
        self.masses = np.array([n for n, _ in sizes], np.float64)
        self.ranks = {w: k for k, w in enumerate(words[:VOCABULARY])}

    def id(self, word: str) -> int:
        rank = self.ranks.get(word)
        return VOCABULARY + self.prefixes.get(word[:2], 0) if rank is None else rank


def start(vocabulary: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights of the unigram model: biases from the counts, no use of the state yet."""
    rng = np.random.default_rng(seed)
    groups = PREFIXES + 1
    counts = np.zeros(VOCABULARY)
    top = vocabulary.counts[:VOCABULARY]
    counts[: len(top)] = top
    mass = np.concatenate([counts.reshape(CLASSES, SIZE).sum(axis=1), np.pad(vocabulary.masses, (0, groups - len(vocabulary.masses)))])
    mass[CLASSES : CLASSES + len(vocabulary.masses)] += 1
    with np.errstate(divide="ignore"):
        p = {
            "x": rng.normal(0, 0.3, (VOCABULARY + groups, 3 * STATE)),
            "u": rng.normal(0, STATE**-0.5, (STATE, 3 * STATE)),
            "c": rng.normal(0, 0.01, (STATE, CLASSES + groups)),
            "cb": np.maximum(np.log(mass / max(mass.sum(), 1)), -1e9),
            "o": rng.normal(0, 0.01, (CLASSES, STATE, SIZE)),
            "ob": np.maximum(np.log(counts.reshape(CLASSES, SIZE) / np.maximum(counts.reshape(CLASSES, SIZE).sum(axis=1, keepdims=True), 1)), -1e9),
        }
    p["x"][:, STATE : 2 * STATE] += 1.0  # the update gate starts by keeping
    return {k: v.astype(np.float32) for k, v in p.items()}


class Room(threading.local):
    """Arrays that are used again in every window, by name: fresh memory costs more than what is done in it."""

    def __init__(self):
        self.held: dict = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind) -> np.ndarray:
        size, key = int(np.prod(shape)), (name, np.dtype(kind))
        if key not in self.held or len(self.held[key]) < size:
            self.held[key] = np.empty(size, kind)
        return self.held[key][:size].reshape(shape)


room = Room()


def chosen(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's log softmax at one column, and the sums of its exponentials, which ``logits`` holds afterwards."""
    rows = np.arange(len(at))
    top = logits.max(initial=0)
    if top > 60:
        logits -= top  # one shift for all; a row that it would leave without mass is shifted by its own
    picked = logits[rows, at].astype(np.float64)
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    if sums.min(initial=1) < 1e-25:
        np.log(np.maximum(logits, 1e-37, out=logits), out=logits)
        logits -= logits.max(axis=1, keepdims=True)
        picked = logits[rows, at].astype(np.float64)
        np.exp(logits, out=logits)
        sums = logits.sum(axis=1)
    return picked - np.log(sums), sums


def outputs(p: dict, states: np.ndarray, targets: np.ndarray, grads: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probabilities of ``targets`` and, with ``grads``, the loss's gradient for the states.

    Rows are put in the order of their classes, so that each class's words are one product; biases are a column of ones.
    """
    n = STATE
    inside = targets < VOCABULARY
    kind = np.where(inside, targets // SIZE, targets - VOCABULARY + CLASSES)
    order = np.argsort(kind.astype(np.uint8), kind="stable")
    kind, word = kind[order], targets[order] % SIZE
    ends = np.searchsorted(kind, np.arange(CLASSES + 1))
    told, many, of = int(ends[CLASSES]), len(targets), p["c"].dtype
    mine = room("mine", (many, n + 1), of)
    np.take(states, order, axis=0, out=mine[:, :n], mode="clip")
    mine[:, n] = 1
    by_class = np.concatenate([p["c"], p["cb"][None]])
    by_word = np.concatenate([p["o"], p["ob"][:, None]], axis=1)
    first, second = room("first", (many, CLASSES + PREFIXES + 1), of), room("second", (told, SIZE), of)
    np.matmul(mine, by_class, out=first)
    spans = [(k, ends[k], ends[k + 1]) for k in range(CLASSES) if ends[k] < ends[k + 1]]
    for k, a, b in spans:
        np.matmul(mine[a:b], by_word[k], out=second[a:b])
    logs, sums = chosen(first, kind)
    more, inner = chosen(second, word[:told])
    logs[:told] += more
    found = np.empty(len(targets))
    found[order] = logs
    if grads is None:
        return found, None
    # softmax less target, with each row's division by its sum done on the narrow side
    first[np.arange(len(kind)), kind] -= sums
    second[np.arange(told), word[:told]] -= inner
    weighed, down = room("weighed", mine.shape, of), room("down", (many, n), of)
    np.divide(mine, sums[:, None], out=weighed)
    both = weighed.T @ first
    grads["c"] += both[:n]
    grads["cb"] += both[n]
    np.matmul(first, p["c"].T, out=down)
    down /= sums[:, None]
    weighed, deep = weighed[:told], room("deep", (told, n), of)
    np.divide(mine[:told], inner[:, None], out=weighed)
    for k, a, b in spans:
        both = weighed[a:b].T @ second[a:b]
        grads["o"][k] += both[:n]
        grads["ob"][k] += both[n]
        np.matmul(second[a:b], p["o"][k].T, out=deep[a:b])
    deep /= inner[:, None]
    down[:told] += deep
    back = room("back", down.shape, of)
    back[order] = down
    return found, back


def window(p: dict, ids: np.ndarray, before: np.ndarray, fresh: np.ndarray, state: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One window [steps, lanes]: log probabilities (0 where padded) and the state after it.

    ids: tokens, -1 for padding; before: the lanes' tokens before the window; fresh: where a document starts.
    Inside, a step's numbers lie unit by unit, lanes side by side, so that every gate is one run of memory.
    """
    steps, lanes = ids.shape
    n, kind = STATE, p["x"].dtype
    given = np.concatenate([before[None], np.maximum(ids[:-1], 0)]).ravel()
    rows, inputs = room("rows", (steps * lanes, 3 * n), kind), room("inputs", (steps, 3 * n, lanes), kind)
    np.take(p["x"], given, axis=0, out=rows, mode="clip")
    across = rows.reshape(steps, lanes, 3 * n).transpose(0, 2, 1)
    np.multiply(across[:, : 2 * n], kind.type(0.5), out=inputs[:, : 2 * n])  # sigmoid(x) = (1 + tanh(x / 2)) / 2
    inputs[:, 2 * n :] = across[:, 2 * n :]
    half = np.ascontiguousarray(p["u"].T)
    half[: 2 * n] *= 0.5
    parts, gates, news = (room(name, (steps, m * n, lanes), kind) for name, m in (("parts", 3), ("gates", 2), ("news", 1)))
    states = room("states", (steps + 1, n, lanes), kind)
    states[0] = state.T
    starts = [np.flatnonzero(f) if some else None for f, some in zip(fresh, fresh.any(axis=1))]
    for t in range(steps):
        part, gate, new, now = parts[t], gates[t], news[t], states[t + 1]
        np.matmul(half, states[t], out=part)
        np.add(part[: 2 * n], inputs[t, : 2 * n], out=gate)
        np.tanh(gate, out=gate)
        gate *= 0.5
        gate += 0.5
        np.multiply(gate[:n], part[2 * n :], out=new)
        new += inputs[t, 2 * n :]
        np.tanh(new, out=new)
        np.subtract(states[t], new, out=now)
        now *= gate[n:]
        now += new
        if starts[t] is not None:
            now[:, starts[t]] = 0
    real = ids >= 0
    at = None if real.all() else np.flatnonzero(real)
    flat = room("flat", (steps * lanes, n), kind)
    flat.reshape(steps, lanes, n)[:] = states[1:].transpose(0, 2, 1)
    found, back = outputs(p, flat if at is None else flat[at], ids.ravel() if at is None else ids.ravel()[at], grads)
    logs = found if at is None else np.zeros(ids.size)
    if at is not None:
        logs[at] = found
    if grads is not None:
        if at is not None:
            flat[:] = 0
            flat[at] = back
            back = flat
        below, rest = room("below", news.shape, kind), room("rest", news.shape, kind)
        below[:] = back.reshape(steps, lanes, n).transpose(0, 2, 1)
        r, z = gates[:, :n], gates[:, n:]
        of_new, of_reset, of_update = (room(name, news.shape, kind) for name in ("of_new", "of_reset", "of_update"))
        np.subtract(states[:-1], news, out=of_update)
        of_update *= z
        np.multiply(news, news, out=of_new)
        np.subtract(1, of_new, out=of_new)
        np.subtract(1, z, out=rest)
        of_update *= rest
        of_new *= rest
        np.subtract(1, r, out=rest)
        np.multiply(parts[:, 2 * n :], r, out=of_reset)
        of_reset *= rest
        carry, of_input = np.zeros((n, lanes), kind), rest
        for t in range(steps - 1, -1, -1):
            d, part, new = below[t], parts[t], of_input[t]
            d += carry
            if starts[t] is not None:
                d[:, starts[t]] = 0
            np.multiply(d, of_new[t], out=new)
            np.multiply(new, of_reset[t], out=part[:n])
            np.multiply(d, of_update[t], out=part[n : 2 * n])
            np.multiply(new, r[t], out=part[2 * n :])
            np.matmul(p["u"], part, out=carry)
            d *= z[t]
            carry += d
        rows, olds = rows.reshape(3 * n, -1), flat.reshape(n, -1)
        rows.reshape(3 * n, steps, lanes)[:] = parts.transpose(1, 0, 2)
        olds.reshape(n, steps, lanes)[:] = states[:-1].transpose(1, 0, 2)
        grads["u"] += olds @ rows.T
        rows[2 * n :].reshape(n, steps, lanes)[:] = of_input.transpose(1, 0, 2)
        of_x = room("of_x", (3 * n, len(p["x"])), kind)
        for own, row in zip(of_x, rows):
            own[:] = np.bincount(given, row, len(own))
        grads["x"] += of_x.T
    return logs.reshape(ids.shape), states[-1].T.copy()


class Trainer:
    """Adam with clipped gradients; all weights lie in one array, of which ``p`` holds views."""

    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.steps, self.work, self.full = p, rate, 0, 0.0, 0
        self.flat = np.concatenate([p[k].ravel() for k in sorted(p)])
        self.first, self.second, self.slope, self.spare = (np.zeros_like(self.flat) for _ in range(4))
        self.slopes, at = {}, 0
        for k in sorted(p):
            shape, end = p[k].shape, at + p[k].size
            p[k], self.slopes[k] = self.flat[at:end].reshape(shape), self.slope[at:end].reshape(shape)
            at = end

    def grads(self) -> dict:
        self.slope[:] = 0
        return self.slopes

    def step(self, grads: dict, tokens: int) -> None:
        """One step along ``grads``, which are those that ``grads()`` gave, as far as its share of a full step's tokens."""
        self.steps += 1
        share = tokens / (self.full or tokens)
        self.work += share
        size = float(np.sqrt(self.slope @ self.slope)) / tokens
        scale = min(1.0, 1.0 / (size + 1e-12)) / tokens
        rate = self.rate * share * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k in range(0, len(self.flat), BLOCK):  # a block at a time, which the processor's cache holds
            flat, first, second, g, spare = (x[k : k + BLOCK] for x in (self.flat, self.first, self.second, self.slope, self.spare))
            g *= scale
            np.multiply(g, g, out=spare)
            spare *= 0.01
            second *= 0.99
            second += spare
            g *= 0.1
            first *= 0.9
            first += g
            np.sqrt(second, out=spare)
            spare += 1e-5
            np.divide(first, spare, out=spare)
            spare *= rate
            flat -= spare


def run(p: dict, docs: list[np.ndarray], lanes: int, trainer: Trainer | None = None) -> np.ndarray:
    """Each document's log10 probability by ``p``; with a trainer, also a step in every window.

    Documents are dealt to lanes, longest first to the shortest lane; lanes are ordered so that those still busy come first.
    Scoring goes through a window in shorter spans, which changes no result and keeps its numbers in the processor's cache.
    """
    if trainer:
        trainer.full = lanes * WINDOW
    lanes = max(1, min(lanes, len(docs)))
    heap = [(0, k) for k in range(lanes)]
    heapify(heap)
    held_by: list[list[int]] = [[] for _ in range(lanes)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        size, k = heap[0]
        held_by[k].append(d)
        heapreplace(heap, (size + len(docs[d]), k))
    held_by.sort(key=lambda ds: -sum(len(docs[d]) for d in ds))
    tokens = [np.concatenate([docs[d] for d in ds]) for ds in held_by if ds]
    owners = [np.repeat(np.array(ds), [len(docs[d]) for d in ds]) for ds in held_by if ds]
    sizes = np.array([len(x) for x in tokens])
    total = np.zeros(len(docs))
    state, last, last_owner = np.zeros((len(tokens), STATE), np.float32), np.zeros(len(tokens), np.int64), np.full(len(tokens), -1)
    span = WINDOW if trainer else max(1, WINDOW * LANES // max(LANES, lanes))
    laid = WINDOW * LAID_OUT
    for k in range(0, int(sizes.max(initial=0)), laid):
        busy, steps = int((sizes > k).sum()), min(laid, int(sizes[0]) - k)
        ids, whose = np.full((steps, busy), -1, np.int64), np.full((steps, busy), -1, np.int64)
        for j in range(busy):
            part = tokens[j][k : k + steps]
            ids[: len(part), j] = part
            whose[: len(part), j] = owners[j][k : k + steps]
        fresh = whose != np.concatenate([last_owner[None, :busy], whose[:-1]])
        for t in range(0, steps, span):
            busy = int((sizes > k + t).sum())
            here, real = ids[t : t + span, :busy], ids[t : t + span, :busy] >= 0
            grads = trainer.grads() if trainer else None
            logs, state = window(p, here, last[:busy], fresh[t : t + span, :busy], state[:busy], grads)
            if grads is not None:
                trainer.step(grads, int(real.sum()))
            total += np.bincount(whose[t : t + span, :busy][real], logs[real], len(docs))
            last = np.maximum(here[-1], 0)
        last_owner = whose[-1]
    return total / np.log(10)


def counted(docs: DataFrame) -> DataFrame:
    """word, c over all training tokens; each task adds up its own before the shuffle."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64())])

    def flush(seen: Counter):
        words, counts = list(seen), list(seen.values())
        for k in range(0, len(words), 50_000):
            yield batch(schema, word=words[k : k + 50_000], c=counts[k : k + 50_000])

    def add_up(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(words_of(text))
                seen[END] += 1
            if len(seen) > 2 * CACHED:
                yield from flush(seen)
                seen = Counter()
        yield from flush(seen)

    return map_batches(docs.select("text"), add_up, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int, int]:
    """The vocabulary with its broadcast counts, N and V; only bounded tops of the counts reach the driver."""
    # the words above the count that KNOWN words reach at most: counts by octave eighths tell it, so no task sends more
    eighth = F.floor(F.log2("c") * 8).cast("int")
    least, above = None, 0
    found = sorted(counts.groupBy(eighth.alias("e")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect(), reverse=True)
    total, types = sum(r["c"] for r in found), sum(r["n"] for r in found)
    for r in found:
        if above + r["n"] > KNOWN:
            break
        least, above = r["e"], above + r["n"]
    if above >= min(VOCABULARY, types):
        top = sorted(counts.where(eighth >= least).collect() if above else [], key=lambda r: (-r["c"], r["word"]))
    else:  # too many words of nearly one count
        top = counts.orderBy(F.desc("c"), "word").limit(KNOWN).collect()
    head = [r["word"] for r in top[:VOCABULARY]]
    spark = counts.sparkSession
    rest = counts.join(F.broadcast(spark.createDataFrame([(w,) for w in head], "word string")), "word", "left_anti") if head else counts
    by = materialize(rest.groupBy(F.substring("word", 1, 2).alias("prefix")).agg(F.sum("c").alias("n"), F.count("*").alias("v")))
    prefixes = by.orderBy(F.desc("n"), "prefix").limit(PREFIXES).collect()
    sums = by.agg(F.sum("n"), F.sum("v")).first()
    others = ((sums[0] or 0) - sum(r["n"] for r in prefixes), (sums[1] or 0) - sum(r["v"] for r in prefixes))
    return Vocabulary([r["word"] for r in top], [r["c"] for r in top], [r["prefix"] for r in prefixes], [others, *((r["n"], r["v"]) for r in prefixes)]), total, types


def encoded(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Each text's tokens as the network's ids (little-endian unsigned 16 bits), beside the columns of ``rows`` but the last, its text.

    uid: a number for the row; n_tokens; n_known, base and inner: tokens with a broadcast count, the sum of their log10(c + 1),
    and what lies inside the classes of tokens beyond the vocabulary; rare: the other tokens, which may have a count, and their number.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vocab)
    kept = [(f.name, f.dataType.simpleString()) for f in rows.schema[:-1]]
    more = "uid long, n_tokens long, n_known long, base double, inner double, ids binary, rare array<struct<word:string,n:long>>"
    item = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        mine = shared.value
        uid = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0
        known = {w: k for k, w in enumerate(mine.words)}
        logs = np.log10(mine.counts + 1.0) if len(mine.counts) else np.zeros(1)
        slot_ids = np.array([mine.id(w) for w in mine.words] or [VOCABULARY], np.int64)
        # a known token's slot, or for others -1 - class
        slots = Cache(lambda w: known[w] if w in known else VOCABULARY - 1 - mine.id(w), CACHED)
        for b in batches:
            slots.trim()
            words, sizes = [], []
            for text in b.columns[-1].to_pylist():
                before = len(words)
                words += words_of(text)
                words.append(END)
                sizes.append(len(words) - before)
            if not sizes:
                continue
            ends = np.cumsum(sizes)
            firsts = ends - sizes
            at = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
            there, slot = at >= 0, np.maximum(at, 0)
            ids = np.where(there, slot_ids[slot], VOCABULARY - 1 - at)
            own = np.where(there, logs[slot], 0.0)
            inner = np.where(ids >= VOCABULARY, own - mine.norms[np.maximum(ids - VOCABULARY, 0)], 0.0)
            small = ids.astype("<u2")
            others = np.flatnonzero(~there)
            cut = np.searchsorted(others, np.append(firsts, len(words)))
            odd = [words[k] for k in others.tolist()]
            counted = [Counter(odd[i:j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
            rare = pa.StructArray.from_arrays([pa.array([w for c in counted for w in c], pa.string()), pa.array([n for c in counted for n in c.values()], pa.int64())], fields=list(item))
            rare = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, counted)]), pa.int32()), rare)
            columns = [*b.columns[:-1], pa.array(range(uid, uid + len(sizes)), pa.int64()), pa.array(sizes, pa.int64())]
            columns += [pa.array(np.add.reduceat(there, firsts, dtype=np.int64)), pa.array(np.add.reduceat(own, firsts)), pa.array(np.add.reduceat(inner, firsts))]
            columns += [pa.array([small[i:j].tobytes() for i, j in zip(firsts, ends)], pa.binary()), rare]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in kept] + ["uid", "n_tokens", "n_known", "base", "inner", "ids", "rare"])
            uid += len(sizes)

    return map_batches(rows, run, ", ".join([*(f"`{n}` {t}" for n, t in kept), more]))


def gathered(batches, column: int):
    """(rows of the other columns, ids) of about GATHER tokens at a time."""
    rows, docs, size = [], [], 0
    for b in batches:
        found = [np.frombuffer(x, "<u2") for x in b.column(column).to_pylist()]
        for row, doc in zip(zip(*(c.to_pylist() for k, c in enumerate(b.columns) if k != column), strict=True) if b.num_columns > 1 else [()] * len(found), found):
            rows.append(row)
            docs.append(doc)
            size += len(doc)
            if size >= GATHER:
                yield rows, docs
                rows, docs, size = [], [], 0
    if docs:
        yield rows, docs


def packed(p: dict) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def unpacked(data: bytes, like: dict) -> dict:
    flat, at, out = np.frombuffer(data, "<f4"), 0, {}
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def fit(docs: DataFrame, vocab: Vocabulary, training: int) -> dict:
    """Weights after the warm-up and one pass of every partition over its training documents (``docs`` holds only those).

    docs: doc_id and text, or what ``encoded`` made of them.
    """
    p = start(vocab)
    spark = docs.sparkSession
    if "ids" not in docs.columns:
        docs = encoded(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), vocab)
    # rows by their hash: about twice as many as are wanted pass the filter, and the limit is exact
    share, rank = int(2**62 * min(1.0, 2 * FIT_DOCS / max(training, 1))), F.xxhash64("doc_id", "ids")
    sample = docs.where(F.col("n_tokens") <= FIT_TOKENS).select(F.shiftrightunsigned(rank, 2).alias("rank"), "ids").where(F.col("rank") <= share)
    warm = [np.frombuffer(r["ids"], "<u2").astype(np.int64) for r in sample.orderBy("rank", "ids").limit(FIT_DOCS).collect()]
    trainer = Trainer(p, WARM_RATE)
    for _ in range(WARM if warm else 0):  # without a sample, all is left to the pass
        run(p, warm, 32, trainer)
    shared = spark.sparkContext.broadcast((vocab, packed(p)))
    schema = pa.schema([("weight", pa.float64()), ("model", pa.binary())])

    def train(batches):
        mine, data = shared.value
        local = unpacked(data, p_like(mine))
        trainer, seen = Trainer(local, RATE), 0
        for _, part in gathered(batches, 0):
            trainer.rate = RATE / (1 + trainer.work / HALVING) ** 0.5
            run(local, part, LANES, trainer)
            seen += sum(map(len, part))
        if seen:
            yield batch(schema, weight=[float(seen)], model=[packed(local)])

    def add(batches):
        weight, total = 0.0, None
        for b in batches:
            for w, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(data, "<f4").astype(np.float64) * w
                weight, total = weight + w, own if total is None else total + own
        if total is not None:
            yield batch(schema, weight=[weight], model=[(total / weight).astype("<f4").tobytes()])

    models = materialize(map_batches(docs.select("ids"), train, "weight double, model binary"))
    while (n := models.count()) > 1:  # a tree of tasks, FAN_IN models in each
        models = materialize(map_batches(models.repartition(-(-n // FAN_IN)), add, "weight double, model binary"))
    found = models.first()
    return unpacked(found["model"], p) if found else p


def p_like(vocab: Vocabulary) -> dict:
    """Arrays of the shapes that the weights have."""
    n, groups = STATE, PREFIXES + 1
    shapes = {"x": (VOCABULARY + groups, 3 * n), "u": (n, 3 * n), "c": (n, CLASSES + groups), "cb": (CLASSES + groups,), "o": (CLASSES, n, SIZE), "ob": (CLASSES, SIZE)}
    return {k: np.zeros(shape, np.float32) for k, shape in shapes.items()}


@scratch
def scores(docs: DataFrame, mod: int = 7, rest: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held("doc_id", mod, rest).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = materialize(counted(rows.where(~F.col("held_out"))))
    vocab, tokens, types = vocabulary(counts)
    ends = int(vocab.counts[vocab.words.index(END)]) if END in vocab.words else 0
    found = materialize(encoded(rows, vocab))
    p = fit(found.where(~F.col("held_out")), vocab, ends)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, packed(p)))
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def score(batches):
        mine, data = shared.value
        weights = unpacked(data, p_like(mine))
        for part, ids in gathered(batches, 0):
            totals = run(weights, ids, WIDE)
            for k in range(0, len(part), 4096):
                inner, *some = map(list, zip(*part[k : k + 4096]))
                yield batch(schema, **dict(zip(schema.names, some)), score=totals[k : k + len(inner)] + inner)

    scored = map_batches(found.select("ids", "inner", "uid", "doc_id", "held_out", "n_tokens", "n_known", "base"), score, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    rare = found.select("uid", F.explode("rare").alias("x")).selectExpr("uid", "x.word word", "x.n n").join(counts, "word")
    more = rare.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("n_more"))
    out = scored.join(more, "uid", "left")
    norm = log10(tokens + types + 1)
    return out.selectExpr(
        "doc_id", "held_out", "n_tokens", "n_known + coalesce(n_more, 0) n_known", f"cast({tokens} as long) train_tokens",
        f"base + coalesce(more, 0D) - n_tokens * {norm!r}D base_score", "score + coalesce(more, 0D) score",
    )
