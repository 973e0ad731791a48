"""op10's tasks hold little more than their n-grams, and what they work on a piece at a time is what it is at once."""

import tracemalloc

import numpy as np
import pytest

from lodestone.llm import elias_fano, language_model
from lodestone.llm.packed import packed


def peak(f):
    """(result, most bytes held meanwhile beyond those before)."""
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        return f(), tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def shard():
    """A shard of trigrams of rare and common words, as it is sent."""
    r = np.random.default_rng(1)
    own = language_model.Words(r.integers(1 << 20, 1 << 62, 5000), r.integers(1, 900, 5000), 900_000, 90_000, 300)
    codes = np.concatenate([np.arange(3, 5003), r.integers(1 << 20, 1 << 62, 5000)])
    texts = [codes[(r.random(1000) ** 2 * len(codes)).astype(int)] for _ in range(400)]
    keys, counts = np.unique(language_model.gram_keys(texts, 1)[0], return_counts=True)
    return own, texts, keys, packed(np.diff(keys, prepend=np.uint64(0))), packed(counts)


def test_op10_a_shard_takes_little_memory(shard):
    own, _, keys, sent, counts = shard
    tree, most = peak(lambda: language_model.Grams(sent, counts, own).trie(own))
    assert most < 110 * len(keys)
    weights, most = peak(lambda: tree.weights(keys))
    assert most < 16 * len(keys) + (16 << 20) and (weights > 0).all()
    asked, most = peak(lambda: language_model.distinct_keys(np.diff(x, prepend=np.uint64(0)) for x in (keys[::2], keys[1::2])))
    assert most < 30 * len(keys) and (asked == keys).all()


def test_op10_keys_are_made_a_piece_at_a_time(shard):
    texts = shard[1] + [np.zeros(0, np.int64), np.full(150_000, 7)] + shard[1][:3]
    want = language_model.gram_keys(texts, 7)
    got, most = peak(lambda: language_model.all_gram_keys(texts, 7))
    assert all((a == b).all() for a, b in zip(got, want)) and most < 14 * len(want[0]) + (32 << 20)
    assert [len(x) for x in language_model.all_gram_keys([], 7)] == [0, 0, 0]


def test_op10_pieces_change_no_trie(shard, monkeypatch):
    own, _, keys, sent, counts = shard
    whole = language_model.Grams(sent, counts, own).trie(own).weights(keys)
    built = elias_fano.encode(keys >> np.uint64(22), 1 << 42)
    monkeypatch.setattr(elias_fano, "PIECE", 1000)
    assert (language_model.Grams(sent, counts, own).trie(own).weights(keys) == whole).all()
    assert elias_fano.encode(keys >> np.uint64(22), 1 << 42) == built


def test_op10_one_key(shard):
    """Packed arrays of one number can't be written to."""
    own = shard[0]
    key = np.array([(5 << 17 | 6) << 22 | 7], np.uint64)
    grams = language_model.Grams(packed(key), packed(np.array([3])), own)
    assert grams.keys.tolist() == key.tolist() and grams.c2.tolist() == [3]
    assert grams.trie(own).weights(key)[0] > 0
