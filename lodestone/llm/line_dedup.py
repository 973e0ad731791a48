"""Line dedup by pairwise alignment.

A line goes if the patience alignment of its document with any earlier one (by doc_id) has it in a block of LEAST_CHARS
characters or more. Not all pairs are aligned for that: a line of such a block lies in a run of neighbouring lines that
just reaches LEAST_CHARS, and documents are paired through hashes of these runs. A run's owner is the first document that holds it, and every later
document with the run is first aligned with the owner. Runs that are not gone then (lines in crossing order, or twice on
one side) are tried with their other earlier holders, until they are gone or no holder is left. Holders that are alike in
all lines that the documents left hold align alike, so only the first of them is tried.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import KEY, cut, keyed, table

#: Characters that a run of lines needs to pair documents, and an aligned block to be deleted.
LEAST_CHARS = 40
#: Holders tried in the first round after the owner; each round tries ROUND times as many as the one before.
ROUND = 4
#: Base of the hashes of runs, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def doc_type(df: DataFrame, name: str = "doc") -> str:
    """name with the type of df's column doc, as a schema."""
    return f"{name} {df.schema['doc'].dataType.simpleString()}"


def longest_rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    tops, last, before = [], [], [0] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        before[i] = last[at - 1] if at else -1
        tops[at : at + 1] = [v]
        last[at : at + 1] = [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Blocks (start in a, start in b, length) of the patience alignment of two lists, in order; 0 never anchors a block."""
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        start = a0
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            a0, b0 = a0 + 1, b0 + 1
        if a0 > start:
            out.append((start, b0 - (a0 - start), a0 - start))
        stop = a1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        if stop > a1:
            out.append((a1, b1, stop - a1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        of_b = {v: j for j, v in enumerate(b[b0:b1], b0) if in_b[v] == 1}
        pairs = [(i, of_b[v]) for i, v in enumerate(a[a0:a1], a0) if v and in_a[v] == 1 and v in of_b]
        if not pairs:
            continue
        rising = [pairs[k] for k in longest_rising([j for _, j in pairs])]
        low_a, low_b = a0, b0
        for i, j in rising:
            if i < low_a:
                continue
            if j < low_b:
                continue
            todo.append((low_a, i, low_b, j))
            n = 1
            while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
                n += 1
            out.append((i, j, n))
            low_a, low_b = i + n, j + n
        todo.append((low_a, a1, low_b, b1))
    merged: list[tuple[int, int, int]] = []
    for i, j, n in sorted(out):
        if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
            merged[-1] = (merged[-1][0], merged[-1][1], merged[-1][2] + n)
        else:
            merged.append((i, j, n))
    return merged


def spans(n: list[int], least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the runs of lines that pair documents, from the lines' lengths.

    From each line, and up to each line, the shortest run of least_chars characters or more: whatever block of that size
    holds a line, one of these runs holds it too and lies inside the block.
    """
    least = max(1, least_chars)
    sums = np.concatenate([[0], np.cumsum(np.array(n, np.int64))])
    first, last = np.flatnonzero(sums[:-1] + least <= sums[-1]), np.flatnonzero(sums[1:] >= least)
    start = np.concatenate([first, np.searchsorted(sums, sums[last + 1] - least, "right") - 1])
    stop = np.concatenate([np.searchsorted(sums, sums[first] + least), last + 1])
    return np.divmod(np.unique(start * len(sums) + stop), len(sums))


def run_hashes(h: list[int], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each run of the lines with hashes h; runs alike have the same."""
    one = np.ones(1, np.uint64)
    lines = np.array(h, np.int64).view(np.uint64) ^ np.uint64(BASE)  # so that blank lines count
    powers, inverse = (np.cumprod(np.concatenate([one, np.full(len(h), x, np.uint64)])) for x in (BASE, INVERSE))
    sums = np.concatenate([one - one, np.cumsum(lines * powers[:-1])])
    return ((sums[stop] - sums[start]) * inverse[start]).view(np.int64)


def aligned(pairs: DataFrame, holders: DataFrame, texts: DataFrame, least_chars: int) -> DataFrame:
    """(doc, line): what goes by the alignments of pairs (doc, owner); holders (owner, theirs), texts (doc, h, n)."""

    def align(batches):
        import pyarrow as pa

        for batch in batches:
            gone = []
            for h, n, theirs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                gone.append([k for _, j, m in patience_blocks(theirs, h) if sum(n[j : j + m]) >= least_chars for k in range(j, j + m)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], ["doc", "gone"])

    both = pairs.select("doc", "owner").join(holders, "owner").join(texts, "doc").select("doc", "h", "n", "theirs")
    return both.mapInArrow(align, f"{doc_type(pairs)}, gone array<int>").select("doc", F.explode("gone").alias("line"))


def by_doc(found: DataFrame) -> DataFrame:
    return found.groupBy("doc").agg(F.collect_set("line").alias("gone"))


def uncovered(asked: DataFrame, texts: DataFrame, found: DataFrame, least_chars: int) -> DataFrame:
    """(doc, u): the runs of asked (doc, u) of which a line is not in found (doc, line)."""

    def left(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for u, h, n, gone in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                start, stop = spans(n, least_chars)
                kept = np.ones(len(n), np.int64)
                kept[gone or []] = 0
                kept = np.concatenate([[0], np.cumsum(kept)])
                own = run_hashes(h, start, stop)
                out.append(list(set(u).intersection(own[kept[stop] > kept[start]].tolist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc", "u"])

    own = asked.groupBy("doc").agg(F.collect_set("u").alias("u")).join(texts, "doc").join(by_doc(found), "doc", "left")
    return own.select("doc", "u", "h", "n", "gone").mapInArrow(left, f"{doc_type(asked)}, u array<long>").select("doc", F.explode("u").alias("u"))


def projected(asked: DataFrame, texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(owner, theirs): the lines of the documents asked (doc), with null for each stretch of lines that neither are blank nor in lines (line)."""

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for h, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                known, own = {0, *known}, []
                for x in h:
                    if x in known:
                        own.append(x)
                    elif not own or own[-1] is not None:
                        own.append(None)
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["owner", "theirs"])

    own = asked.join(texts, "doc")
    known = own.select("doc", F.explode(F.array_distinct("h")).alias("line")).join(lines, "line").groupBy("doc").agg(F.collect_set("line").alias("known"))
    return own.join(known, "doc").select("doc", "h", "known").mapInArrow(project, f"{doc_type(asked, 'owner')}, theirs array<long>")


def removals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(KEY, gone): positions from 0 of the lines that go, for the documents that lose any."""

    def runs(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for h, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append(np.unique(run_hashes(h, *spans(n, least_chars))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], ["doc", "h", "n", "u"])

    lines = F.split(F.coalesce(F.col(text_column), F.lit("")), "\n", -1)
    one = F.transform(lines, lambda x: F.struct(F.when(F.trim(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(F.trim(x))).alias("h"), F.length(F.trim(x)).alias("n")))
    own = keyed(docs.select(id_column, text_column), id_column, text_column)
    own = own.select(*KEY, one.alias("l")).select(F.struct(*KEY).alias("doc"), F.col("l.h").alias("h"), F.col("l.n").alias("n")).distinct()
    whole = cut(own.mapInArrow(runs, f"{doc_type(own)}, h array<long>, n array<int>, u array<long>"), "lines")
    texts, each = whole.drop("u"), whole.select("doc", F.explode("u").alias("u"))
    shared = each.groupBy("u").agg(F.min("doc").alias("owner"), F.count(F.lit(1)).alias("df")).where("df > 1")
    held = cut(each.join(shared, "u").select("doc", "u", "owner"), "held")
    later = held.where("doc <> owner")
    holders = texts.select(F.col("doc").alias("owner"), F.col("h").alias("theirs"))
    found = cut(aligned(later.select("doc", "owner").distinct(), holders, texts, least_chars), "gone")

    left = cut(uncovered(later, texts, found, least_chars), "left")
    if not left.isEmpty():
        candidates = cut(held.join(left.select("u").distinct(), "u").select("u", F.col("doc").alias("owner")), "holders")
        lines_left = left.select("doc").distinct().join(texts, "doc").select(F.explode("h").alias("line")).distinct()
        holders = cut(projected(candidates.select(F.col("owner").alias("doc")).distinct(), texts, lines_left), "projected")
        first = holders.groupBy("theirs").agg(F.min("owner").alias("first"))
        ranked = candidates.join(holders.join(first, "theirs"), "owner").select("u", F.col("first").alias("owner")).distinct()
        ranked = cut(ranked.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("owner"))), "ranked")
        tried, more = 0, ROUND
        while not left.isEmpty():
            pairs = left.join(ranked.where((F.col("rank") > tried) & (F.col("rank") <= tried + more)), "u").where("owner < doc")
            found = cut(found.union(aligned(pairs.select("doc", "owner").distinct(), holders, texts, least_chars)).distinct(), "gone")
            tried, more = tried + more, more * ROUND
            open_ = left.join(ranked.where(F.col("rank") == tried + 1), "u").where("owner < doc").select("doc", "u")
            left = cut(uncovered(open_, texts, found, least_chars), "left")
    return by_doc(found).select("doc.*", "gone")


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(row, text, n_lines, n_removed) of every row of docs: the row itself, its text less the deleted lines, its lines before, and how many were deleted.

    Documents are ordered by doc_id, nulls last, then by a hash of the text. Rows alike in both are one document: they
    lose the same lines. Null texts stay null; empty and blank lines go only inside a deleted block.
    """
    own = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    gone = cut(removals(own, "doc_id", "text", least_chars), "gone")
    joined = keyed(own).join(gone, list(KEY), "left")
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")  # linear, however many lines go
    rest = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **more) -> DataFrame:
    """docs with deduplicated texts, in their own columns, without the documents of which only white space was left by a deletion."""
    out = dedup(docs, id_column, text_column, **more).where("n_removed = 0 OR trim(text) <> ''")
    return out.select(*(F.col("text").alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "text", "n_lines", "n_removed")
