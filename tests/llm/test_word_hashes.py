"""Words are hashed many at once, with the hashes of one at a time."""

import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import language_model, word_hashes


def plain(texts):
    return [[xxhash.xxh64_intdigest(w) for w in t.lower().split()] for t in texts]


def got(texts):
    return [h[a:b].tolist() for h, edges in word_hashes.word_hashes(texts) for a, b in zip(edges[:-1], edges[1:])]


@pytest.mark.parametrize("chunk", [1 << 20, 50])
def test_word_hashes_are_xxh64(monkeypatch, chunk):
    monkeypatch.setattr(word_hashes, "CHUNK", chunk)
    r = random.Random(1)
    odd = [bytes([c]) for c in range(256)] + [b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"] * 20
    texts = [b"".join(r.choices(odd, k=r.randrange(300))) for _ in range(300)]
    texts += [b"", b" ", b"A", b"\xc3\x84a\xc2\xa0B \xe2\x80\x83", b"\x00 \x00\x00"]
    texts += [bytes(r.randrange(65, 123) for _ in range(n)) for n in range(100)]
    for some in ([], [b""], texts):
        assert got(some) == plain(some)


def test_long_texts_are_cut_between_words():
    texts = [b"a bc " * 300_000, b"x", b"y" * 1_500_000 + b" z", b" ".join(b"W%d" % i for i in range(200_000))]
    assert got(texts) == plain(texts)


def test_op10_words_are_not_met_one_by_one(monkeypatch):
    """New words cost no call each: only those of 32 bytes or more are hashed alone. Codes and counts are those of plain code."""
    r = np.random.default_rng(3)
    long = b"l" * 40
    texts = [b" ".join(b"W%d" % i for i in r.integers(0, 20_000, 3000)) + b" " + long for _ in range(20)] + [None, b"", b"the the"]
    lists = [(t or b"").lower().split() for t in texts]
    types = sorted({w for x in lists for w in x})
    signed = {w: int(language_model.signed(np.array([xxhash.xxh64_intdigest(w)], np.uint64))[0]) for w in types}
    common = types[::3]
    own = language_model.Words(np.array([signed[w] for w in common], np.int64), np.ones(len(common), np.int64), 9, 9, 9)
    ids = signed | {w: language_model.FIRST + i for i, w in enumerate(common)}
    calls, plain_hash = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *x: calls.append(x[0]) or plain_hash(*x))
    codes = list(language_model.Reader(own).codes(texts))
    assert [c.tolist() for c in codes] == [[ids[w] for w in x] for x in lists]
    assert set(calls) == {long}
    assert language_model.signed(np.array([0, 5, 1 << 17, 1 << 63], np.uint64)).tolist() == [1 << 50, 1 << 50 | 5, 1 << 17, -1 << 63]


@pytest.mark.parametrize("sizes", [(1 << 20, 500_000), (50, 20)])
def test_op10_word_counts(spark, monkeypatch, sizes):
    for name, value in zip(("SORTED", "HELD"), sizes):
        monkeypatch.setattr(language_model, name, value)
    r = random.Random(2)
    texts = [" ".join(r.choices(["a", "B", "b", "é", "cc", " ", "w" * 50], k=r.randrange(40))) + f" x{i % 70}" for i in range(200)] + [None, "", "\t"]
    want = {}
    for h in (h for t in texts for h in plain([(t or "").encode()])[0]):
        h = int(language_model.signed(np.array([h], np.uint64))[0])
        want[h] = want.get(h, 0) + 1
    counts = language_model.word_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert {x.h: x.c for x in counts.collect()} == want
    assert language_model.word_counts(spark.createDataFrame([], "text string")).collect() == []
