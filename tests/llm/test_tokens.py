"""Byte-level BPE and token counts against the libraries themselves, and exact round trips."""

import base64
import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from relloom.llm import bpe, tokencount  # noqa: E402


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def plain(ranks):
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=known, special_tokens={})


@pytest.fixture(scope="module")
def word_spec():
    return bpe.load_ranks(P.path("word_bpe_49k.json")).decode()


TEXTS = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aab'  \n\t.0é"))) | st.text("a ") | st.text("ab1'\n s", max_size=300)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encoding_is_the_library_s_and_comes_back(text):
    coder, other = bpe.codec(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN), _plain()
    ids = coder.encode([text])[0]
    want = other.encode_ordinary(text)
    assert ids == struct.pack(f"<{len(want)}I", *want)
    assert coder.decode(ids) == text.encode()
    assert "".join(coder.pieces(want)) == text
    assert coder.offsets(text)[0] == want


_PLAIN = []


def _plain():
    if not _PLAIN:
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
        _PLAIN.append(tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=known, special_tokens={}))
    return _PLAIN[0]


def test_digests_of_odd_rows(spark, docs, odd, ranks, plain):
    rows = bpe.digests(docs(odd), ranks, P.PATTERN).collect()
    assert len(rows) == len(odd)
    want = sorted((str(i), len(plain.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in rows) == want
    assert bpe.digests(docs(odd).limit(0), ranks, P.PATTERN).count() == 0


def test_encode_then_decode_tables(spark, docs, odd, ranks):
    ids = bpe.encode(docs(odd), ranks, P.PATTERN)
    back = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(ids, ranks, P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in odd}


def test_worker_cache_stays_bounded(ranks):
    coder = bpe.Codec(ranks, P.PATTERN)
    coder.cache.cap = 50
    for k in range(30):
        coder.encode([" ".join(f"w{k}x{j}" for j in range(40))])
    assert len(coder.cache) <= 50 + 40 and len(coder.cache.old) <= 50 + 40


@settings(max_examples=200, deadline=None)
@given(TEXTS | st.sampled_from(["<|endoftext|>", "a<|startoftext|>b IT'S", "\x1c a\x1fb", "İ ß ẞ Σς"]))
def test_counts_are_the_library_s(text):
    assert _counter().count([text]) == [len(_counter().tokenizer.encode(text, add_special_tokens=False).ids)]


_COUNTER = []


def _counter():
    if not _COUNTER:
        spec = bpe.load_ranks(P.path("word_bpe_49k.json")).decode()
        _COUNTER.append(tokencount.Counts(spec, ["it's", "the"], bytes([2, 1])))
    return _COUNTER[0]


def test_latin1_short_way(word_spec):
    counter = tokencount.Counts(word_spec)
    assert counter.short
    texts = ["a" + chr(x) + "'" + chr(y) + "1b" for x in range(256) for y in range(0, 256, 5)]
    assert counter.count(texts) == [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_count_rows(spark, docs, odd, word_spec):
    rows = tokencount.counts(docs(odd), word_spec, limit=4).collect()
    counter = tokencount.Counts(word_spec)
    want = sorted((str(i), len((t or "").encode()), n, n > 4) for (i, t), n in zip(odd, counter.count([t or "" for _, t in odd])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == want
    assert tokencount.counts(docs(odd).limit(0), word_spec).count() == 0


def test_frequent_finds_heavy_words_in_bounded_memory(spark, docs, monkeypatch):
    monkeypatch.setattr(tokencount, "SUMMARY", 100)
    table = docs([(k, "common " * 20 + " ".join(f"r{k}x{j}" for j in range(40))) for k in range(30)])
    assert tokencount.frequent(table, 1) == ["common"]
