"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints within 2 bits share at least 6 of their 8 positional bytes, so of the 4 byte pairs at least 2 are
whole; postings are kept for the 6 choices of two byte pairs (two positional bytes twice), which keeps them short where
postings of single bytes would hold 1/256 of all rows. Within a posting the shared positional bytes of each pair are
tallied, pairs with the guaranteed 6 are kept and verified bit by bit, and only a spanning forest of each posting's
links leaves it. Copies meet as one fingerprint before the index.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import KEY, binary_list, cut, keyed, table
from lodestone.llm.components import stars

#: Bits that may differ, and positional bytes that are then shared at least.
DISTANCE, SHARED = 2, 6
#: Postings longer than this are searched by flipping bits, in time linear in their length.
LONG_POSTING = 512


def fingerprint(text: bytes, size: int = 3) -> int:
    """Unsigned SimHash of the word shingles of text: A-Z lower-cased, words parted by ASCII white space, XXH64 with seed 42. 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - size + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(size, len(words)) - 1 :].tolist()
    hashes = np.fromiter((xxh64_intdigest(line[i:j], 42) for i, j in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keys: list[str], text_column: str = "text") -> DataFrame:
    """The columns keys and fp, the fingerprint's bits as a signed long. A null text has no words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t or b"") for t in binary_list(batch.column(len(keys)))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], [*keys, "fp"])

    own = docs.select(*keys)
    return docs.select(*keys, F.col(text_column).alias("__text")).mapInArrow(run, own.schema.add("fp", "long"))


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the 8 bytes of each xor are zero."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(1)


def links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the distinct fingerprints of one posting that share SHARED bytes and differ in DISTANCE bits at most."""
    n = len(fps)
    if n <= LONG_POSTING:
        i, j = np.triu_indices(n, 1)
        x = fps[i] ^ fps[j]
        kept = shared_bytes(x) >= SHARED
        i, j, x = i[kept], j[kept], x[kept]
        close = np.bitwise_count(x) <= DISTANCE
        return i[close], j[close]
    order = np.argsort(fps)
    ranked, found = fps[order], []
    flips = [sum(1 << b for b in bits) for k in range(1, DISTANCE + 1) for bits in combinations(range(64), k)]
    apart = int(np.bitwise_or.reduce(fps ^ fps[0]))  # bits in which this posting differs at all
    for flip in flips:
        if flip & ~apart:
            continue
        at = np.searchsorted(ranked, ranked ^ np.uint64(flip))
        at[at == n] = 0
        hit = np.flatnonzero((ranked[at] == ranked ^ np.uint64(flip)) & (np.arange(n) < at))
        found.append((order[hit], order[at[hit]]))
    return tuple(np.concatenate(c) for c in zip(*found))


def forest(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) that connect the same fingerprints as the pairs do, one for each but the roots."""
    root = np.arange(len(fps))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            moved = np.flatnonzero(root != np.arange(len(fps)))
            return fps[moved], fps[root[moved]]
        root = new


def near_links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between the fingerprints of a column fp of distinct longs, spanning all links."""
    halves = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = [F.shiftleft(F.lit(s).cast("long"), 32).bitwiseOR(F.shiftleft(halves[p], 16)).bitwiseOR(halves[q]) for s, (p, q) in enumerate(combinations(range(4), 2))]
    postings = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).repartition("key").sortWithinPartitions("key")

    def run(batches):
        import pyarrow as pa

        def edges(keys, fps):
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            out = []
            for a, b in zip(starts[stops - starts > 1].tolist(), stops[stops - starts > 1].tolist()):
                i, j = links(fps[a:b])
                if len(i):
                    out.append(forest(fps[a:b], i, j))
            if out:
                a, b = (np.concatenate(c).view(np.int64) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # of one key, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            fps, keys = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            if held and held[-1][0][-1] == keys[-1]:
                held.append((keys, fps))
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            held.append((keys[:last], fps[:last]))
            yield from edges(*(np.concatenate(c) for c in zip(*held)))
            held = [(keys[last:], fps[last:])]
        if held:
            yield from edges(*(np.concatenate(c) for c in zip(*held)))

    return postings.mapInArrow(run, "a long, b long")


def components(marked: DataFrame, least: Column) -> DataFrame:
    """(fp, component) of every distinct fp of marked: the aggregate least over all rows whose fingerprints links connect."""
    nodes = cut(marked.groupBy("fp").agg(least.alias("least")), "nodes")
    star = stars(near_links(nodes.select("fp")))
    linked = star.union(star.select("b", "b").distinct())
    whole = cut(linked.join(nodes, linked.a == nodes.fp).groupBy("b").agg(F.min("least").alias("component")), "wholes")
    of_linked = linked.join(whole, "b").select(F.col("a").alias("fp"), "component")
    return cut(nodes.join(of_linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")), "components")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the least doc_id reachable over links of at most 2 differing bits.

    Null and empty texts have fingerprint zero and link like others. Repeated rows stay, with the same values. A null
    doc_id never is a component_id unless its component has no other.
    """
    marked = cut(fingerprints(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), ["doc_id"]), "fingerprints")
    ids = components(marked, F.min("doc_id"))
    return marked.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of docs for each component, in their own columns: that with the least doc_id (nulls last), of those the one with the least hash of its text."""
    own = keyed(docs.select(F.struct("*").alias("row"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    marked = cut(fingerprints(own.select(*KEY, "text"), list(KEY)), "fingerprints")
    chosen = components(marked, F.min(F.struct(*KEY))).select("component.*").distinct()
    return own.join(chosen, list(KEY), "left_semi").dropDuplicates(list(KEY)).select("row.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
