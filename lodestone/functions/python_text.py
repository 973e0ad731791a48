"""Text functions that have no built-in: NFKC and the longest common subsequence. Arrow-batched."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import TYPOGRAPHY


def nfkc(text: Column) -> Column:
    """text in Unicode normal form KC."""

    def normal(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(normal, "string")(text)


def typographic_normal(text: Column) -> Column:
    """NFKC with typographic quotes, spaces and dashes as their plain forms."""
    return F.translate(nfkc(text), "".join(TYPOGRAPHY), "".join(TYPOGRAPHY.values()))


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit for each element of b (Hyyro, 2004). What both begin and end with is in it."""
    least, first, last = min(len(a), len(b)), 0, 0
    while first < least and a[first] == b[first]:
        first += 1
    while last < least - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return first + last + len(b) - row.bit_count()


def _f1(p: str | None, r: str | None) -> float:
    a, b = (p or "").lower().split(), (r or "").lower().split()
    n = _common(a, b) if a and b else 0
    return round(2 * n / (len(a) + len(b)), 4) if n else 0.0


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of lower-cased words, to 4 digits; 0 if either side has no word."""

    def score(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(list(map(_f1, p, r)), dtype=float)

    return F.pandas_udf(score, "double")(prediction, reference)
