"""Quality, language and toxicity: held-out accuracy on made corpora, defined results for odd rows."""

import collections
import math
import random
import unicodedata

import numpy as np
import pytest

from relloom.llm import common, langid, quality, toxicity
from relloom.llm.common import held_id

GOOD = ["ta", "ren", "mo", "li", "sha", "ver", "an", "do"]


def sentence(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        text, q, t = sentence(rng, GOOD, rng.randint(10, 60)), 1, 0
        if i % 4 == 0:
            q = 0
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join([rng.choice(text.split())] * 40), text.replace(" ", "$$$ ")])
        if i % 5 == 0:
            t = 1
            words = text.split()
            for _ in range(4):
                words[rng.randrange(len(words))] = "zub" + rng.choice(GOOD)  # unseen words with a known stem
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, q, t))
    return rows, labels


def test_quality_held_out(spark, docs, labels, corpus, odd):
    rows, known = corpus
    model = quality.train(docs(rows), labels(known))
    got = {r["doc_id"]: r for r in quality.scores(docs(rows), model).collect()}
    test = [(i, q) for i, q, _ in known if held_id(i, 5, 0)]
    assert all(got[i]["held_out"] == held_id(i, 5, 0) for i, _ in rows)
    assert np.mean([got[i]["predicted"] == q for i, q in test]) >= 0.95
    out = quality.scores(docs(odd), model).collect()
    assert len(out) == len(odd) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.keep(docs(odd), model, least=0.0).count() == len(odd)
    assert quality.keep(docs(odd), model).columns == docs(odd).columns


def test_quality_ignores_labels_of_held_out_rows(spark, docs, labels, corpus):
    rows, known = corpus
    turned = [(i, 1 - q if held_id(i, 5, 0) else q, t) for i, q, t in known]
    one, two = (quality.train(docs(rows), labels(x)) for x in (known, turned))
    assert np.array_equal(one.vectors, two.vectors) and np.array_equal(one.bias, two.bias)


def test_quality_without_training_rows(spark, docs, labels, odd):
    model = quality.train(docs(odd), labels([]))
    assert all(r["score"] == pytest.approx(0.5) for r in quality.scores(docs(odd), model).collect())
    assert quality.scores(docs(odd).limit(0), model).count() == 0


def test_a_text_cut_over_steps_scores_alike(corpus):
    rows, known = corpus
    model = quality.fit([(i, t, q) for (i, t), (_, q, _) in zip(rows, known)], (100, 300))
    text = " ".join(t for _, t in rows[:40]) + " same" * 30
    whole = quality.Scorer(model.folded(), model.bias)
    cut = quality.Scorer(model.folded(), model.bias)
    cut.rows.STEP = 7
    assert cut.scores([text, "a b", text]) == pytest.approx(whole.scores([text, "a b", text]))


def plain_score(model, text):
    """A document's score by the definition: the average of all its features' vectors, one at a time, then softmax."""
    words = text.split()
    vectors = []
    for k, w in enumerate(words):
        ids, _ = quality.features([w])
        vectors += [model.vectors[i].astype(float) for i in ids]
        if k and w == words[k - 1]:
            vectors += [model.vectors[quality.BUCKETS].astype(float)] * int(quality.REPEAT)
    hidden = sum(vectors) / len(vectors) if vectors else np.zeros(quality.DIM)
    logits = hidden @ model.output + model.bias
    return float(np.exp(logits[1]) / np.exp(logits).sum())


def test_scores_match_the_plain_definition(corpus):
    rows, known = corpus
    model = quality.fit([(i, t, q) for (i, t), (_, q, _) in zip(rows, known)], (100, 300))
    rng = random.Random(9)
    texts = [rng.choice(rows)[1] for _ in range(20)] + ["", "a", "a a a", "日本 日本 x", " ".join(rng.choices(["ab", "ab", "cde", "é"], k=500))]
    scorer = quality.Scorer(model.folded(), model.bias)
    assert scorer.scores(texts) == pytest.approx([plain_score(model, t) for t in texts], abs=1e-4)


def test_training_matches_plain_steps(monkeypatch):
    """The gradient of the log loss, document by document and feature by feature."""
    monkeypatch.setattr(quality, "EPOCHS", 2)
    sample = [(1, "good words here here", 1), (2, "BAD!! words", 0), (3, "more good words", 1), (4, "", 0)]
    got = quality.fit(sample, (2, 2), seed=3)
    rng = np.random.default_rng(3)
    vectors = rng.uniform(-0.5 / quality.DIM, 0.5 / quality.DIM, (quality.BUCKETS + 1, quality.DIM)).astype(np.float32).astype(float)
    output, bias, step = np.zeros((quality.DIM, 2)), np.zeros(2), 0
    for _ in range(2):
        for k in rng.permutation(4):
            ids, shares = quality.bag(sample[k][1])
            rate = quality.RATE * (1 - step / 8)
            step += 1
            hidden = sum((w * vectors[i] for i, w in zip(ids, shares)), np.zeros(quality.DIM))
            loss = lambda h, o, b: -(h @ o + b)[sample[k][2]] + np.log(np.exp(h @ o + b).sum())  # noqa: B023, E731
            nudge = lambda f, n: np.array([(f(1e-6 * e) - f(-1e-6 * e)) / 2e-6 for e in np.eye(n)])
            of_hidden = nudge(lambda d: loss(hidden + d, output, bias), quality.DIM)  # noqa: B023
            of_output = nudge(lambda d: loss(hidden, output + d.reshape(output.shape), bias), output.size).reshape(output.shape)  # noqa: B023
            of_bias = nudge(lambda d: loss(hidden, output, bias + d), 2)  # noqa: B023
            for i, w in zip(ids, shares):
                vectors[i] -= rate * min(len(ids), 1000) ** 0.5 * w * of_hidden
            output, bias = output - rate * of_output, bias - 0.1 * rate * of_bias
    assert np.allclose(got.vectors, vectors, atol=1e-4) and np.allclose(got.output, output, atol=1e-4)
    seen = np.log(np.array([3, 3]) / 6)
    assert np.allclose(got.bias, bias + np.log(np.array([3, 3]) / 6) - seen, atol=1e-4)


def test_languages(spark, docs, odd):
    rng = random.Random(2)
    parts = {"aa": ["ka", "ru", "mi", "to"], "bb": ["sch", "ein", "ung", "ber"], "cc": ["eau", "oi", "que", "tre"]}
    rows, lang = [], {}
    for i in range(240):
        name = rng.choice(list(parts))
        rows.append((i, sentence(rng, parts[name], rng.randint(4, 30))))
        lang[i] = name
    profiles = langid.train(docs(rows, lang))
    got = {r["doc_id"]: r for r in langid.predict(docs(rows), profiles).collect()}
    test = [i for i, _ in rows if held_id(i, 4, 2)]
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in test]) >= 0.97
    out = {r["doc_id"]: r for r in langid.predict(docs(odd + [(20, "12 34 !!")]), profiles).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3, 20))
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert sorted(r["doc_id"] for r in langid.keep(docs([(1, None), (2, "kato"), (3, "1")]), profiles).collect()) == [2]
    nothing = langid.train(docs(odd).limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs(odd), nothing).collect()} == {"und"}


def plain_order(text):
    """A document's n-grams in order, by the definition: letters are what Unicode calls letters."""
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()
    counts = collections.Counter(g for w in words for g in langid.grams(w))
    return sorted(counts, key=lambda g: (-counts[g], [0] * (3 - len(g)) + [ord(c) for c in g]))[: langid.RANKS]


def test_distance_matches_the_plain_definition():
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzéüñßжщ日本語ʻªdž"
    text = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) + rng.choice(["", ",", "½", "7", "-x", "\u0301"]) for _ in range(n))
    texts = [text(n) for n in (1, 2, 5, 40, 400, 3000, 20000)]
    ranked = {name: plain_order(text(800)) for name in ("x", "y", "z")}
    profiles = langid.Profiles(ranked)
    for t, (name, score, fit, many) in zip(texts, profiles.judge(texts)):
        own = plain_order(t)
        apart = {x: sum(abs(k - p.index(g)) if g in p else langid.RANKS for k, g in enumerate(own)) for x, p in ranked.items()}
        first, second = sorted(apart.values())[:2]
        assert many == len(own) and apart[name] == first and name == min(x for x in apart if apart[x] == first)
        assert score == pytest.approx(1 - first / (first + second)) and fit == pytest.approx(1 - first / (langid.RANKS * len(own)))
    assert [x[0] for x in profiles.judge(texts)] == [x[0] for x in profiles.judge(texts[::-1])][::-1]  # the cache changes nothing


def test_only_letters_count():
    """Of every Unicode category, only letters make a text one that has a language."""
    profiles = langid.Profiles({"x": ["a", "_a"], "y": ["b"]})
    some = collections.defaultdict(list)
    for k in range(0x110000):
        if not 0xD800 <= k < 0xE000:
            some[unicodedata.category(chr(k))].append(chr(k))
    for category, chars in some.items():
        found = profiles.judge([f" {c} 12 {c}" for c in chars[:300]])
        assert {x[0] != "und" for x in found} == {category[0] == "L"}, category
        if category[0] != "L":
            assert {x[1] for x in found} == {0.0}
    assert profiles.judge(["½", "①", "²", "Ⅷ", "७ ½", "", None]) == [("und", 0.0, 0.0, 0)] * 7


def test_profiles_are_learned_from_a_bounded_sample(spark, docs, monkeypatch):
    """Copies count once, and no more different texts than FIT_DOCS are read, whatever their lengths."""
    monkeypatch.setattr(langid, "FIT_DOCS", 20)
    trained = [i for i in range(600) if not held_id(i, 4, 2)]
    rows = [(i, "copy of one text") for i in trained[:200]] + [(i, f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} " * (30000 if i % 50 == 0 else 3)) for i in trained[200:]]
    lang = {i: "aa" for i, _ in rows}
    found = langid.sample(docs(rows, lang), 4, 2).collect()
    assert len(found) == len({r["text"] for r in found}) == 20
    texts = [t for t in {t for _, t in rows}]
    ranked = plain_order(" ".join(r["text"] for r in found))
    assert langid.train(docs(rows, lang)).keys.tolist() == sorted(map(langid.packed, ranked)) and len(texts) > 20


def test_texts_in_no_learned_language_go(spark, docs):
    rng = random.Random(3)
    parts = {"aa": ["ka", "ru", "mi", "to"], "bb": ["sch", "ein", "ung", "ber"]}
    rows = [(i, sentence(rng, parts["aa" if i % 2 else "bb"], 40)) for i in range(200)]
    profiles = langid.train(docs(rows, {i: "aa" if i % 2 else "bb" for i, _ in rows}))
    strange = [(300, sentence(rng, ["жи", "щу", "ры", "бо", "кл", "эх"], 200)), (301, sentence(rng, ["日", "本", "語", "学", "校", "東", "京"], 200)), (302, "жи"), (303, "12 ½")]
    kept = lambda **more: {r["doc_id"] for r in langid.keep(docs(rows + strange), profiles, **more).collect()}
    assert kept() == {i for i, _ in rows} | {302}
    assert kept(languages=["aa"]) <= {i for i, _ in rows if i % 2} | {302} and len(kept(languages=["aa"])) >= 98
    nothing = langid.Profiles({})
    assert {r["doc_id"] for r in langid.keep(docs(rows + strange), nothing).collect()} == {i for i, _ in rows} | {300, 301, 302}
    assert langid.keep(docs(rows).limit(0), profiles).count() == 0


def test_toxicity_held_out_and_passages(spark, docs, labels, corpus, odd):
    rows, known = corpus
    model = toxicity.train(docs(rows), labels(known))
    got = {r["doc_id"]: r for r in toxicity.scores(docs(rows), model).collect()}
    test = [(i, t) for i, q, t in known if held_id(i, 3, 1) and q]
    assert np.mean([got[i]["predicted"] for i, t in test if t]) >= 0.9
    assert np.mean([got[i]["predicted"] for i, t in test if not t]) <= 0.02
    spans = toxicity.toxic_passages(docs(rows[:40]), model).collect()
    assert spans and all("zub" in r["words"] for r in spans)
    out = toxicity.scores(docs(odd), model).collect()
    assert len(out) == len(odd) and all(0 <= r["score"] <= 1 and not r["predicted"] for r in out)
    calm = toxicity.train(docs(odd), labels([]))
    assert len({r["score"] for r in toxicity.scores(docs(odd), calm).collect()}) == 1


def test_segments_are_ruzzo_and_tompa_s():
    assert toxicity.segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0])) == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]
    rng = np.random.default_rng(0)
    for _ in range(50):
        scores = rng.integers(-4, 5, 30).astype(float)
        total = np.concatenate([[0], np.cumsum(scores)])
        best = max((total[j] - total[i] for i in range(30) for j in range(i + 1, 31)), default=0)
        found = toxicity.segments(scores)
        assert max((x for _, _, x in found), default=0) == max(best, 0)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def plain_segments(scores, start=0):
    """All maximal segments by the definition: the best stretch (shortest, then first), and the same left and right of it."""
    best = max(((sum(scores[i:j]), i - j, -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    total, _, _, i, j = best
    return [*plain_segments(scores[:i], start), (start + i, start + j, total), *plain_segments(scores[j:], start + j)]


def test_toxicity_scores_match_a_quadratic_scan(corpus):
    rows, known = corpus
    model = toxicity.fit([(i, t, y) for (i, t), (_, _, y) in zip(rows, known)], (320, 80))
    cache = toxicity.Cache(model.score_token, 1000)
    rng = random.Random(12)
    tested = 0
    for _, text in rng.sample(rows, 40) + [(0, ""), (1, "zub"), (2, "ta ren " * 15 + "zubta zubmo")]:
        words = toxicity.tokens(text)
        scores = [max([model.odds[p] for p in toxicity.parts(w) if p in model.odds], default=0.0) - toxicity.DRIFT for w in words]
        found = plain_segments(scores)
        assert [x[:2] for x in toxicity.segments(np.array(scores, float))] == [x[:2] for x in found]
        best, total = 0.0, 0.0
        for r, (_, _, score) in enumerate(sorted(found, key=lambda x: -x[2])[: toxicity.BEST], 1):
            total += model.rate * score - math.log(model.size * len(words))
            if total > 0:
                best = max(best, total - (r - 1) * math.log(total) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)) - (r * math.log(2) if r > 1 else 0))
        want = min(toxicity.MOST, best / math.log(10))
        assert model.surprise(words, cache) == pytest.approx(want, abs=1e-9)
        assert model.probability(want) == pytest.approx(1 / (1 + math.exp(-(model.offset + model.slope * want))))
        tested += want > 0
    assert tested >= 3


def test_an_id_that_occurs_often_is_sampled_once(spark, labels):
    rows = spark.range(100_000).selectExpr("cast(id % 5 as long) doc_id", "concat('text ', id % 10) text")
    found = common.labelled_sample(rows, labels([(i, i % 2, 0) for i in range(5)]), "quality", 5, 0, 10, 1000)
    assert len(found) == len({i for i, _, _ in found}) == sum(not held_id(i, 5, 0) for i in range(5))
