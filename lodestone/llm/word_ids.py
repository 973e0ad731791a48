"""Words of several documents as one NumPy array of numbers."""

from __future__ import annotations

from itertools import chain

import numpy as np

#: Documents are worked on together up to so many bytes; a longer one is alone.
GROUP_BYTES = 4 << 20


def groups(texts: list[bytes], size: int = GROUP_BYTES):
    """(from, to) of consecutive texts of about size bytes together."""
    at = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield at, i
            at, total = i, 0
        total += len(text)
    if at < len(texts):
        yield at, len(texts)


def numbered(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all lists one after another as numbers, equal only for equal words of one list; where each list begins, and the end; how often each number occurs."""
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    base, parts = 0, []
    for words in lists:
        own = dict.fromkeys(words)
        own = dict(zip(own, range(base, base + len(own))))
        base += len(own)
        parts.append(map(own.__getitem__, words))
    ids = np.fromiter(chain.from_iterable(parts), np.int64, int(starts[-1]))
    return ids, starts, np.bincount(ids, minlength=base)
