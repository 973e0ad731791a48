"""Periodic runs of words by Karp-Miller-Rosenberg naming.

Level k names every stretch of 2^k words so that equal names are equal stretches: a name of level k stands for a pair of
names of level k - 1. A run of period q has at least 3q places whose word comes again q places on, so it holds a whole
block of a grid of step 2^j, with 2^(j+1) <= 3q + 1, whose name of level j comes again q places on. These are the
candidates; each is extended to both sides by the longest common extension (LCE), which goes down the levels once. Names
are ranks of pairs: nothing is hashed, and no suffix is sorted. Several documents are named together; words of different
documents never have equal numbers, so nothing reaches across their borders.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import binary_list, crc_of_id, table
from lodestone.llm.word_ids import groups, numbered

#: Least words of a run, and least periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Candidates that are compared at once.
CHUNK = 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


class Names:
    """Names of all levels of an array of words. Stretches that occur once have negative names, each its own."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        own = -1 - np.arange(len(ids))
        level = np.where(counts[ids] > 1, ids, own)
        self.levels = [level]
        width = 1
        while len(level) > width:
            again = np.flatnonzero((level[:-width] >= 0) & (level[width:] >= 0))
            pairs = level[again] * (int(level.max(initial=0)) + 1) + level[again + width]
            _, name, count = np.unique(pairs, return_inverse=True, return_counts=True)
            more = count[name] > 1
            if not more.any():
                break
            level = own.copy()
            level[again[more]] = name[more]
            self.levels.append(level)
            width *= 2

    def forward(self, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many words from at on are those from other on (at < other)."""
        at, other, n, out = at.copy(), other.copy(), len(self.levels[0]), np.zeros(len(at), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            inside = other < n
            same = inside.copy()
            same[inside] = self.levels[k][at[inside]] == self.levels[k][other[inside]]
            step = same.astype(np.int64) << k
            at += step
            other += step
            out += step
        return out

    def backward(self, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many words before at are those before other (at < other)."""
        at, other, out = at.copy(), other.copy(), np.zeros(len(at), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            inside = at >= 1 << k
            same = inside.copy()
            same[inside] = self.levels[k][at[inside] - (1 << k)] == self.levels[k][other[inside] - (1 << k)]
            step = same.astype(np.int64) << k
            at -= step
            other -= step
            out += step
        return out


def _periods(level: int) -> tuple[int, int]:
    """The periods whose candidates are blocks of this level: the largest level with two blocks, less a word, in the words that come again in a shortest run."""

    def of(q):
        return (max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) + 1).bit_length() - 2

    low = next(q for q in range(1, 2 << level) if of(q) >= level) if level else 1
    high = low
    while of(high) == level:
        high += 1
    return low, high


def candidates(names: Names):
    """(place, period) arrays: the first block of every row of blocks that come again that many words on."""
    n = len(names.levels[0])
    for j in range(1, len(names.levels)):
        level, step = names.levels[j], 1 << j
        low, high = _periods(j)
        grid = np.arange(0, n, step)
        grid = grid[level[grid] >= 0]
        if low == high or not len(grid):
            continue
        periods = np.arange(low, high)
        rows = max(1, CHUNK // len(periods))
        for at in range(0, len(grid), rows):
            place = np.repeat(grid[at : at + rows], len(periods))
            period = np.tile(periods, len(grid[at : at + rows]))
            kept = place + period < n
            place, period = place[kept], period[kept]
            kept = level[place] == level[place + period]
            place, period = place[kept], period[kept]
            before = place - step
            first = (before < 0) | (level[before] != level[before + period])
            yield place[first], period[first]


def runs_of(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and least period of every run of an array of words, by start and period."""
    names = Names(ids, counts)
    found = [(np.zeros(0, np.int64),) * 3]
    for place, period in candidates(names):
        left = names.backward(place, place + period)
        length = left + names.forward(place, place + period) + period
        kept = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append((place[kept] - left[kept], length[kept], period[kept]))
    start, length, period = map(np.concatenate, zip(*found))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a stretch of several periods is one run, that of the least: the least divides the others, so its stretch is the same
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run is cut to its first period."""
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, start + length, -1)
    return np.cumsum(covered[:-1]) == 0


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed) of every row: its runs by start and period, and its words without the repeats, joined by one space.

    A run is a stretch of words with least period q, of at least 6 words and four periods, that no word beside it
    continues; of every run the first period stays. Words are what ASCII white space separates. A null or empty text has
    no runs and an empty collapsed text; equal rows give equal rows, and an empty table none. Nothing is shuffled; a
    task holds 4 MB of texts at once, or one longer text.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        inner = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            texts = [t or b"" for t in binary_list(batch.column(1))]
            for low, high in groups(texts):
                lists = [t.split() for t in texts[low:high]]
                ids, starts, counts = numbered(lists)
                start, length, period = runs_of(ids, counts)
                stays = kept_words(len(ids), start, length, period)
                cut = np.add.reduceat(~stays, starts[:-1][np.diff(starts) > 0]) > 0 if len(ids) else np.zeros(0, bool)
                shorter = np.zeros(len(lists), bool)
                shorter[np.diff(starts) > 0] = cut
                collapsed = [b" ".join(words if not less else [w for w, s in zip(words, stays[a:b].tolist()) if s]) for words, less, a, b in zip(lists, shorter, starts[:-1], starts[1:])]
                at = np.searchsorted(start, starts)
                own = np.searchsorted(starts, start, side="right") - 1
                values = pa.StructArray.from_arrays([pa.array(x) for x in (start - starts[own], length, period)], fields=list(inner))
                runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {kind}, runs {RUNS}, collapsed string")


def _bound(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def planted(docs: DataFrame) -> DataFrame:
    """documents in which every tenth text, by a hash of its id, goes round in its own words from a place on: the input that op12's contract names. A null id plants nothing."""
    h = crc_of_id()
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def round_(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    again = _bound(words, lambda w: F.when(F.size(w) > 0, round_(w)).otherwise(""))
    return docs.select("doc_id", F.when(h % 10 == 0, again).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row a document from periodic_runs: the number of runs, the longest (ties: least start, then period), and digests of all runs and of the collapsed text."""
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    own = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("first"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    length, period = -F.col("first.less"), F.col("first.period")
    return own.select(
        "doc_id",
        "n_runs",
        F.col("first.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))
