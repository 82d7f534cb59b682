"""The language model: gradients by differences, proper distributions, base scores by hand."""

import collections
import random
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from relloom.llm import grulm
from relloom.llm.common import held_id


@pytest.fixture(scope="module")
def vocab():
    rng = random.Random(0)
    words = [""] + [f"w{k}" for k in range(3000)]
    counts = sorted((rng.randint(1, 1000) for _ in words), reverse=True)
    return grulm.Vocabulary(words, counts, ["w1", "w2"], [(40, 10), (500, 300), (20, 5)])


def test_probabilities_sum_to_one(vocab):
    p = grulm.start(vocab)
    state = np.random.default_rng(0).normal(0, 1, (1, grulm.STATE)).astype(np.float32)
    p["c"] += 0.3
    every = np.arange(grulm.VOCABULARY + grulm.PREFIXES + 1)
    logs, _ = grulm.outputs(p, np.repeat(state, len(every), axis=0), every, None)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)


def test_gradients_match_differences(vocab):
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in grulm.start(vocab).items()}
    for k in ("c", "o"):
        p[k] += rng.normal(0, 0.2, p[k].shape)
    ids = rng.integers(0, grulm.VOCABULARY + 3, (6, 4))
    ids[4:, 3] = -1
    fresh = np.zeros(ids.shape, bool)
    fresh[0, 0] = fresh[3, 1] = True
    before, state = rng.integers(0, 50, 4), rng.normal(0, 0.5, (4, grulm.STATE)).astype(np.float32)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grulm.window(p, ids, before, fresh, state.copy(), grads)
    loss = lambda: -grulm.window(p, ids, before, fresh, state.copy())[0].sum()
    for k in p:
        flat, g = p[k].reshape(-1), grads[k].reshape(-1)
        for at in np.argsort(-np.abs(g))[:4]:
            old = flat[at]
            flat[at] = old + 1e-3
            up = loss()
            flat[at] = old - 1e-3
            down = loss()
            flat[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-3), k


def test_state_is_carried_whatever_the_lanes(vocab):
    p = grulm.start(vocab)
    rng = np.random.default_rng(2)
    p["c"] = rng.normal(0, 0.5, p["c"].shape).astype(np.float32)
    docs = [rng.integers(0, 500, n) for n in (100, 1, 7, 64, 33, 5, 250)]
    alone = [grulm.run(p, [d], 1)[0] for d in docs]
    assert np.allclose(grulm.run(p, docs, 3), alone, rtol=1e-4)
    assert np.allclose(grulm.run(p, docs, 100), alone, rtol=1e-4)


def slowly(p, vocab, words):
    """log10 probability of a text by a plain loop over its tokens."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    n, state, total = grulm.STATE, np.zeros(grulm.STATE), 0.0
    for k, word in enumerate(words):
        if k:
            x, u = p["x"][vocab.id(words[k - 1])], state @ p["u"]
            r, z = sigmoid(x[:n] + u[:n]), sigmoid(x[n : 2 * n] + u[n : 2 * n])
            state = z * state + (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :])
        kinds, at = softmax(state @ p["c"] + p["cb"]), vocab.id(word)
        if at < grulm.VOCABULARY:
            total += log10(kinds[at // grulm.SIZE]) + log10(softmax(state @ p["o"][at // grulm.SIZE] + p["ob"][at // grulm.SIZE])[at % grulm.SIZE])
        else:
            total += log10(kinds[at - grulm.VOCABULARY + grulm.CLASSES])
    return total


def test_scores_match_a_loop_over_tokens(vocab):
    rng = np.random.default_rng(4)
    p = grulm.start(vocab)
    for k in ("c", "o", "u"):
        p[k] += rng.normal(0, 0.3, p[k].shape).astype(np.float32)
    texts = [[f"w{rng.integers(0, 3000)}" for _ in range(n)] + [""] for n in (0, 1, 5, 31, 32, 33, 150)]
    ids = [np.array([vocab.id(w) for w in t]) for t in texts]
    assert np.allclose(grulm.run(p, ids, grulm.WIDE), [slowly(p, vocab, t) for t in texts], rtol=1e-4)


def test_weights_of_a_small_step_move_by_its_share(vocab):
    """The tail of one long document, alone in its lane, doesn't train as fast as full steps do."""
    whole, part = ({k: v.copy() for k, v in grulm.start(vocab).items()} for _ in range(2))
    moved = []
    for p, docs in ((whole, [np.arange(32)] * 4), (part, [np.arange(32)])):
        before = p["cb"].copy()
        grulm.run(p, docs, 4, grulm.Trainer(p, 0.01))
        moved.append(np.abs(p["cb"] - before).max())
    assert moved[1] == pytest.approx(moved[0] / 4, rel=0.1)


def test_training_lowers_the_loss(vocab):
    rng = np.random.default_rng(3)
    docs = [np.tile(rng.integers(0, 30, 3), 40) for _ in range(40)]
    p = grulm.start(vocab)
    before = grulm.run(p, docs, 16).sum()
    grulm.run(p, docs, 16, grulm.Trainer(p, 0.01))
    assert grulm.run(p, docs, 16).sum() > before


def corpus(n=120):
    rng = random.Random(5)
    vocabularies = [[f"{a}{k}" for k in range(60)] for a in ("xa", "yb", "zc")]
    return [(i, " ".join(rng.choice(vocabularies[i % 3]) for _ in range(rng.randint(5, 60)))) for i in range(n)]


@pytest.fixture
def passes(spark, docs, monkeypatch):
    """The steps' tokens of each trainer when ``fit`` runs on the driver over rows in one partition, and its weights."""
    made = []

    class Noted(grulm.Trainer):
        def __init__(self, p, rate):
            super().__init__(p, rate)
            self.tokens = []
            made.append(self.tokens)

        def step(self, grads, tokens):
            self.tokens.append(tokens)
            super().step(grads, tokens)

    def here(df, fn, schema):
        found = list(fn(df.toArrow().to_batches()))
        return spark.createDataFrame(pa.Table.from_batches(found)) if found else spark.createDataFrame([], schema)

    def fit(rows):
        vocab, _, _ = grulm.vocabulary(grulm.counted(docs(rows)))
        with monkeypatch.context() as m:
            m.setattr(grulm, "Trainer", Noted)
            m.setattr(grulm, "map_batches", here)
            return made, vocab, grulm.fit(docs(rows), vocab, len(rows))

    return fit


def test_every_training_token_has_a_gradient(passes):
    rows = [(k, f"a{k} b " * 300) for k in range(20)]
    made, _, _ = passes(rows)
    assert sum(made[-1]) == 20 * 601


def test_size_of_the_model_and_of_its_steps(passes):
    """A smaller network, or fewer steps over the same tokens, is a lesser model, not a cheaper one."""
    made, _, p = passes([(k, f"a{k} b " * 16) for k in range(300)])
    assert p["u"].shape == (24, 72) and max(made[-1]) <= 128 * 32


def test_long_documents_alone_train_the_network(passes):
    rows = [(k, f"a{k} b " * 12000) for k in range(3)]
    made, vocab, p = passes(rows)
    assert all(len(t.split()) > grulm.FIT_TOKENS for _, t in rows) and sum(made[-1]) == 3 * 24001
    assert not np.array_equal(p["u"], grulm.start(vocab)["u"])


def test_scores_by_hand(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(grulm, "KNOWN", 50)  # so that the join of rare tokens is used as well
    rows = corpus() + [(1000 + k, t) for k, (_, t) in enumerate(odd)]
    got = {r["doc_id"]: r for r in grulm.scores(docs(rows)).collect()}
    cut = {i: [w.decode() for w in (t or "").encode().lower().split()] + [""] for i, t in rows}
    counts = collections.Counter(w for i, ws in cut.items() if not held_id(i, 7, 2) for w in ws)
    norm = log10(sum(counts.values()) + len(counts) + 1)
    for i, ws in cut.items():
        r = got[i]
        assert r["n_tokens"] == len(ws) and r["n_known"] == sum(w in counts for w in ws) and r["train_tokens"] == sum(counts.values())
        assert r["base_score"] == pytest.approx(sum(log10(counts[w] + 1) - norm for w in ws))
        assert r["held_out"] == held_id(i, 7, 2) and r["score"] < 0
    test = [r for i, r in got.items() if held_id(i, 7, 2) and i < 1000]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def test_nothing_to_learn_from(spark, docs):
    rows = [(i, t) for i, t in [(k, "a b") for k in range(60)] if held_id(i, 7, 2)]
    out = grulm.scores(docs(rows)).collect()
    assert len(out) == len(rows) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] == pytest.approx(0, abs=1e-4) for r in out)
    assert grulm.scores(docs(rows).limit(0)).count() == 0
