"""XXH64 of all words of many texts at once, ASCII letters lower-cased."""

from __future__ import annotations

import numpy as np

from lodestone.llm.common import slices
from lodestone.llm.word_ids import groups

#: Bytes of text worked on at once; what is made of them stays in a processor's cache.
CHUNK = 1 << 20
#: Words of fewer bytes are hashed together, those of one length at a time; XXH64 has no lanes below it.
LANES = 32
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _of_length(data: bytes, at: np.ndarray, size: int) -> np.ndarray:
    """XXH64 (seed 0) of the size bytes of data, fewer than LANES, from each place; 8 bytes can be read anywhere."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    x, k = np.full(len(at), P5 + np.uint64(size)), 0
    while size - k >= 8:
        x ^= _turned(eights[at + k] * P2, 31) * P1
        x = _turned(x, 27) * P1 + P4
        k += 8
    if k < size:
        rest = eights[at + k]  # fewer than 8 bytes of it are the word's
        if size - k >= 4:
            x ^= (rest & np.uint64(0xFFFFFFFF)) * P1
            x = _turned(x, 23) * P2 + P3
            rest >>= np.uint64(32)
            k += 4
        for _ in range(size - k):
            x ^= (rest & np.uint64(0xFF)) * P5
            x = _turned(x, 11) * P1
            rest >>= np.uint64(8)
    x = (x ^ x >> np.uint64(33)) * P2
    x = (x ^ x >> np.uint64(29)) * P3
    return x ^ x >> np.uint64(32)


def _chunk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): the hashes of the texts' words one after another; where each text's begin, and the end."""
    from xxhash import xxh64_intdigest

    data = b"\n".join([b"", *texts, bytes(8)]).lower()
    own = np.frombuffer(data, np.uint8)[:-8]
    white = (own - np.uint8(9) < 5) | (own == 32)
    turns = np.flatnonzero(white[1:] != white[:-1]) + 1  # it begins and ends with white space
    start, size = turns[::2], turns[1::2] - turns[::2]
    out = np.empty(len(start), np.uint64)
    order = np.argsort(np.minimum(size, LANES).astype(np.uint8), kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(np.minimum(size, LANES), minlength=LANES + 1))])
    for n in range(1, LANES):
        if edges[n] < edges[n + 1]:
            rows = order[edges[n] : edges[n + 1]]
            out[rows] = _of_length(data, start[rows], n)
    for i in order[edges[LANES] :].tolist():
        out[i] = xxh64_intdigest(data[start[i] : start[i] + size[i]])
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return out, np.searchsorted(start, begin)


def word_hashes(texts: list[bytes]):
    """(hashes, edges) of consecutive texts, as many as are worked on at once: the XXH64 (seed 0, unsigned) of the words, runs of no ASCII white space, and where each text's begin, and the end."""
    for a, b in groups(texts, CHUNK):
        if b - a == 1:
            parts = [_chunk([part])[0] for part in slices(texts[a])]
            whole = parts[0] if len(parts) == 1 else np.concatenate(parts)
            yield whole, np.array([0, len(whole)])
        else:
            yield _chunk(texts[a:b])
