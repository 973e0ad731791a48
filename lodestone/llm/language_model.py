"""Language-model scoring with a sharded Elias-Fano n-gram trie.

A trigram model over all words, with hierarchical Dirichlet smoothing (MacKay and Peto) in which the strength of the
bigram prior follows the count of the word before:

    P(w) = (c(w) + 1) / (N + V + 1),  P(w | v) = (c(v w) + A P(w)) / (c(v) + A),
    P(w | u v) = (c(u v w) + B(v) P(w | v)) / (c(u v) + B(v)),  B(v) = (c(v) + A) / K

Its logarithm is a sum over n-grams that occur: log P(w) + back(v) + W(v w) + back(u v) + W(u v w), with
W(v w) = log(1 + c(v w) / (A P(w))), W(u v w) = log(1 + K c(u v w) / (c(v w) + A P(w))), back(v) = log(A / (c(v) + A)) and
back(u v) = log(B(v) / (c(u v) + B(v))). What an n-gram (.. v w) needs is counts of itself, of (v w) and of w, so each shard
of the trie, which holds the trigrams of its (v, w), adds up its own part of every document's score. Documents reach the
shards as blocks: the distinct n-grams of about a million tokens with the documents that hold them. Shards are as many
as the training tokens need, so that neither a shard nor what is asked of it grows with the corpus. A and K are those
that give the training texts, each token left out in turn, the greatest likelihood.

The commonest words have small ids, and their counts reach every task; all other words are met by hashes of their bytes,
and their counts by joins. That is for speed alone: all words are in the model, and all n-grams in the trie.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import binary_lists, crc_of_id, cut, shuffle_partitions, table
from lodestone.llm.elias_fano import BEFORE_BITS, PIECE, Trie
from lodestone.llm.packed import pa_bytes, pack_parts, packed, parts_of, unpacked
from lodestone.llm.word_hashes import word_hashes

#: Words with ids of their own, whose counts are broadcast; ids have WORD_BITS bits.
COMMON, WORD_BITS = 130_000, 17
#: Bits of a pair's first word if that is rare and the last is not.
V_BITS = 40 - WORD_BITS
UNKNOWN, START, END, FIRST = range(4)
#: Values of A and K that are tried.
STRENGTHS, TRUSTS = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0), (0.1, 0.4, 1.6, 6.4, 25.6, 102.4, 409.6, 1638.4)
#: Training tokens of a shard: at most, and at least where shards are only as many as shuffle partitions.
SHARD_TOKENS, LEAST_TOKENS = 4_000_000, 250_000
BLOCK = 1 << 20
#: Tokens whose hashes are sorted together, and distinct words of a task that are held before they are passed on.
SORTED, HELD = 1 << 20, 500_000


def signed(hashes: np.ndarray) -> np.ndarray:
    """Words' hashes as signed numbers that never are numbers that word ids use."""
    return np.where(hashes >> np.uint64(WORD_BITS) == 0, hashes | np.uint64(1 << 50), hashes).view(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c): hash and count of every word of the column text."""

    def run(batches):
        import pyarrow as pa

        held, new, n = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

        def settled():
            """held with the new tokens."""
            fresh = np.sort(np.concatenate(new)) if new else np.zeros(0, np.uint64)
            new.clear()
            first = run_starts(fresh)
            keys, counts = np.concatenate([held[0], fresh[first]]), np.concatenate([held[1], np.diff(np.append(first, len(fresh)))])
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = run_starts(keys)
            return keys[first], np.add.reduceat(counts, first) if len(first) else counts

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(signed(held[0])), pa.array(held[1])], ["h", "c"])

        for batch in batches:
            for hashes, _ in chain.from_iterable(word_hashes([t or b"" for t in texts]) for texts in binary_lists(batch.column(0))):
                new.append(hashes)
                n += len(hashes)
                if n > SORTED:
                    held, n = settled(), 0
                    if len(held[0]) > HELD:
                        yield rows()
                        held = held[0][:0], held[1][:0]
        held = settled()
        if len(held[0]):
            yield rows()

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def run_starts(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(new_values(values))


def new_values(values: np.ndarray) -> np.ndarray:
    """Which values differ from the one before them."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


def by_shard(shards: np.ndarray, count: int):
    """(shard, slice) of runs, for rows ordered by shard."""
    edges = np.searchsorted(shards, np.arange(count + 1))
    for s in range(count):
        if edges[s] < edges[s + 1]:
            yield s, slice(edges[s], edges[s + 1])


class Words:
    """What every task needs of the training words: hashes and counts of the common ones, by id, and totals."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, types: int, texts: int):
        self.hashes, self.tokens, self.types, self.texts = hashes, tokens, types, texts
        self.counts = np.concatenate([[0, texts, texts], counts]).astype(np.float64)
        self.strength, self.trust = 1.0, 1.0

    def p(self, counts):
        """The unigram probability of a word with this count."""
        return (counts + 1.0) / (self.tokens + self.types + 1)

    def back(self, counts):
        """log10 of what the bigram level leaves to the unigrams after a word with this count."""
        return np.log10(self.strength / (counts + self.strength))

    def back2(self, pair_counts, counts):
        """log10 of what the trigram level leaves to the bigrams after a pair, the last word of which has this count."""
        b = (counts + self.strength) / self.trust
        return np.log10(b / (pair_counts + b))


def common_words(words: DataFrame, texts: int, size: int = COMMON) -> tuple[Words, int]:
    """The words that get ids, and the least count of them. Words of one count class are in or out together."""
    row = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    bucket = F.floor(F.log2("c") * 16)
    sizes = words.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("b")).collect()  # 1,024 rows at most
    least, n = 1 << 62, 0
    for r in sizes:
        if n + r.n > size:
            break
        n, least = n + r.n, r.least
    own = words.where(F.col("c") >= least).orderBy(F.desc("c"), "h").collect()  # size rows at most
    hashes, counts = np.array([r.h for r in own], np.int64), np.array([r.c for r in own], np.int64)
    return Words(hashes, counts, int(row[0]) + texts, int(row[1]) + bool(texts), texts), least


class Reader:
    """Texts as codes of words: ids of the common ones, hashes of the others."""

    #: Bits of a hash that say where among the common words' hashes, rising, to seek it.
    BITS = 18

    def __init__(self, known: Words):
        hashes = known.hashes.view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = np.append(hashes[order], np.uint64(0)), np.append(order + FIRST, 0)
        self.first = np.searchsorted(hashes[order], np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS))
        self.first = np.append(self.first, len(hashes))

    def codes(self, texts: list[bytes | None]):
        """The codes of each text's words."""
        for hashes, edges in word_hashes([t or b"" for t in texts]):
            out = signed(hashes)
            sought = out.view(np.uint64)
            part = (sought >> np.uint64(64 - self.BITS)).astype(np.int64)
            at, stop = self.first[part], self.first[part + 1]
            ids = np.where(self.hashes[at] == sought, self.ids[at], 0)
            rows = np.flatnonzero((ids == 0) & (at + 1 < stop))
            while len(rows):
                at[rows] += 1
                ids[rows] = np.where(self.hashes[at[rows]] == sought[rows], self.ids[at[rows]], 0)
                rows = rows[(ids[rows] == 0) & (at[rows] + 1 < stop[rows])]
            codes = np.where(ids > 0, ids, out)
            yield from (codes[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()))


def rare(codes: np.ndarray) -> np.ndarray:
    """Which codes are hashes."""
    return codes >> WORD_BITS != 0


def mixed(codes: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
    x = codes.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) + np.asarray(more, np.int64).view(np.uint64)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def top(x: np.ndarray, bits: int) -> np.ndarray:
    return x >> np.uint64(64 - bits)


def gram_keys(texts: list[np.ndarray], shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, shards, texts' numbers) of the trigram (u, v, w) that ends at each word, and at the end, of the texts.

    A key is the pair (v, w), PAIR_BITS, then u, BEFORE_BITS. Common words have their ids in it, others as many bits of their
    hashes as there is room for, so that few n-grams of rare words share a key. A pair with a rare w lies in the shard of w.
    """
    start, end = np.array([START, START], np.int64), np.array([END], np.int64)
    line = np.concatenate([x for t in texts for x in (start, t, end)])
    sizes = np.array([len(t) + 3 for t in texts])
    number = np.repeat(np.arange(len(texts)), sizes)[2:]
    inside = number == np.repeat(np.arange(len(texts)), sizes)[:-2]
    seldom = rare(line)
    plain = line.view(np.uint64)
    at = np.flatnonzero(seldom)
    before = plain.copy()
    before[at] = np.uint64(1 << BEFORE_BITS - 1) | top(mixed(line[at]), BEFORE_BITS - 1)
    inside = np.flatnonzero(inside)
    before, plain_v, plain_w = before[inside], plain[inside + 1], plain[inside + 2]
    w_rare, v_rare = seldom[inside + 2], seldom[inside + 1]
    v, w = plain_v.view(np.int64), plain_w.view(np.int64)
    pair = plain_v << np.uint64(WORD_BITS) | plain_w
    at = np.flatnonzero(v_rare & ~w_rare)
    pair[at] = np.uint64(1 << 40) | plain_w[at] << np.uint64(V_BITS) | top(mixed(v[at]), V_BITS)
    shard = (top(mixed(v, w), 32) % np.uint64(shards)).astype(np.int64)
    at = np.flatnonzero(w_rare)
    pair[at] = np.uint64(2 << 40) | top(mixed(w[at]), 24) << np.uint64(16) | top(mixed(v[at]), 16)
    shard[at] = w[at] % shards
    return pair << np.uint64(BEFORE_BITS) | before, shard, number[inside]


def all_gram_keys(texts: list[np.ndarray], shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gram_keys of many texts, made of some at a time, so that of each token no more is held than the three; the last two as small numbers."""
    n = sum(len(t) + 1 for t in texts)
    keys, own, number = np.empty(n, np.uint64), np.empty(n, np.uint16 if shards < 1 << 16 else np.int64), np.empty(n, np.uint32)
    at = first = 0
    while first < len(texts):
        stop, size = first + 1, len(texts[first]) + 1
        while stop < len(texts) and size + len(texts[stop]) + 1 <= PIECE:
            size += len(texts[stop]) + 1
            stop += 1
        x = slice(at, at + size)
        keys[x], own[x], number[x] = gram_keys(texts[first:stop], shards)
        number[x] += np.uint32(first)
        at, first = at + size, stop
    return keys, own, number


def word_counts_of(pairs: np.ndarray, counts: np.ndarray, known: Words) -> np.ndarray:
    """The count of the last word of each pair (rising): a common word's is known, and all the trigrams of a rare one are in its shard."""
    kind = (pairs >> np.uint64(40)).astype(np.int64)
    ids = np.where(kind == 0, pairs & np.uint64((1 << WORD_BITS) - 1), (pairs >> np.uint64(V_BITS)) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    out = known.counts[np.where(kind == 2, 0, ids)]
    first = int(np.searchsorted(kind, 2))
    if first < len(pairs):
        which = np.cumsum(np.diff(pairs[first:] >> np.uint64(16), prepend=pairs[first] >> np.uint64(16)) != 0)
        out[first:] = np.bincount(which, counts[first:])[which]
    return out


def ends(pairs: np.ndarray) -> np.ndarray:
    """Which pairs end a text."""
    kind = pairs >> np.uint64(40)
    mask = np.uint64((1 << WORD_BITS) - 1)
    return (kind == 0) & (pairs & mask == END) | (kind == 1) & ((pairs >> np.uint64(V_BITS)) & mask == END)


def order_of(keys: np.ndarray) -> np.ndarray:
    """A stable order of unsigned keys. Sorting numbers is far faster than sorting their places, so halves of the keys are sorted with the places below them."""
    if len(keys) >> 24:
        return np.argsort(keys, kind="stable")
    place = np.arange(len(keys), dtype=np.uint64)

    def placed(x):
        """The order of 32-bit x, which is overwritten with it."""
        x <<= np.uint64(24)
        x |= place
        x.sort()
        x &= np.uint64((1 << 24) - 1)
        return x.view(np.int64)

    order = placed(keys & np.uint64(0xFFFFFFFF))
    high = keys[order]
    high >>= np.uint64(32)
    return order[placed(high)]


def risen(differences: bytes) -> np.ndarray:
    """Rising keys of which the differences are packed."""
    x = unpacked(differences, np.uint64)
    return np.cumsum(x, out=x if x.flags.writeable else None)


def shards_of(tokens: int, partitions: int) -> int:
    return max(1, -(-tokens // SHARD_TOKENS), min(partitions, -(-tokens // LEAST_TOKENS)))


def labels_of(spark: SparkSession, shards: int) -> list[int]:
    """Numbers for the shards that hashing deals evenly over the shuffle partitions."""
    parts = shuffle_partitions(spark)
    want = [-(-(shards - k) // parts) for k in range(parts)]
    out: list[list[int]] = [[] for _ in range(parts)]
    hashes = spark.range(0, 4 * shards + 16 * parts, 1, 1).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)))
    for i, (part,) in enumerate(hashes.collect()):  # a few small rows for each shard and partition
        if len(out[part]) < want[part]:
            out[part].append(i)
    if [len(x) for x in out] != want:
        return list(range(shards))
    return [out[s % parts][s // parts] for s in range(shards)]


GRAMS = "s int, keys binary, counts binary"


def gram_counts(texts: DataFrame, known, labels: list[int]) -> DataFrame:
    """(s, keys, counts): a row for each shard with the trigrams of the column text, rising, and how often they occur."""
    shards = len(labels)

    def count(batches):
        import pyarrow as pa

        reader, held, n = Reader(known.value), [], 0

        def flush():
            keys, own, _ = all_gram_keys(held, shards)
            held.clear()
            order = order_of(keys)
            keys, own = keys[order], own[order]
            starts = run_starts(keys)
            counts = np.diff(np.append(starts, len(keys))).astype(np.uint32)
            keys, own = keys[starts], own[starts]
            order = np.argsort(own, kind="stable")
            keys, counts, own = keys[order], counts[order], own[order]
            rows = [(labels[s], packed(np.diff(keys[x], prepend=np.uint64(0))), packed(counts[x])) for s, x in by_shard(own, shards)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["s", "keys", "counts"])

        for batch in batches:
            for codes in chain.from_iterable(map(reader.codes, binary_lists(batch.column(0)))):
                held.append(codes)
                n += len(codes) + 1
                if n > 3 * BLOCK // 2:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def merge(group):
        import pyarrow as pa

        keys = np.concatenate([risen(k.as_py()) for k in group.column(1)])
        order = order_of(keys)
        keys = keys[order]
        counts = np.concatenate([unpacked(c.as_py(), np.uint32) for c in group.column(2)])[order].astype(np.int64)
        starts = run_starts(keys)
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        row = [group.column(0)[0].as_py()], [packed(np.diff(keys, prepend=np.uint64(0)))], [packed(counts)]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("s", "keys", "counts"), row, (pa.int32(), pa.binary(), pa.binary()))})

    return texts.mapInArrow(count, GRAMS).groupBy("s").applyInArrow(merge, GRAMS)


class Grams:
    """The counts of a shard: trigram keys and their counts, pairs with theirs and those of their last words."""

    def __init__(self, keys: bytes, counts: bytes, known: Words):
        self.keys, self.c3 = risen(keys), unpacked(counts, np.int64)
        first = run_starts(self.keys >> np.uint64(BEFORE_BITS))
        self.pairs = self.keys[first] >> np.uint64(BEFORE_BITS)
        self.c2 = np.add.reduceat(self.c3, first)
        self.c1 = word_counts_of(self.pairs, self.c2, known)
        self.p1 = known.p(self.c1)
        self.sizes = np.diff(np.append(first, len(self.keys)))

    def trie(self, known: Words) -> Trie:
        """The trie of the shard; the counts go as they are used."""
        third = known.trust * self.c3
        third /= np.repeat(self.c2 + known.strength * self.p1, self.sizes)
        del self.c3, self.sizes
        third += 1
        np.log10(third, out=third)
        second = np.log10(1 + self.c2 / (known.strength * self.p1)) + np.where(ends(self.pairs), 0.0, known.back2(self.c2, self.c1))
        del self.pairs, self.c2, self.c1, self.p1
        return Trie(Trie.build(self.keys, second, third))

    def strength_terms(self) -> list[float]:
        """For each strength, the sum over bigram tokens, each left out, of the logarithm of what its probability divides by c(v) - 1 + A."""
        return [float((self.c2 * np.log(self.c2 - 1 + a * self.p1)).sum()) for a in STRENGTHS]

    def trust_terms(self, a: float) -> list[float]:
        """For each trust, the sum over trigram tokens, each left out, of the logarithm of its probability (less the texts' first tokens' common divisor)."""
        rest, c1, c2 = np.repeat(self.c2 - 1 + a * self.p1, self.sizes), self.c1[~ends(self.pairs)], self.c2[~ends(self.pairs)]
        once = self.c3 == 1  # most trigrams; what they give is the same for every trust
        alike, c3, rest = np.log(rest[once]).sum(), self.c3[~once], rest[~once]
        return [float(alike + (c3 * np.log(k * (c3 - 1) + rest)).sum() - (c2 * np.log(k * (c2 - 1) + c1 - 1 + a)).sum()) for k in TRUSTS]


def fitted(grams: DataFrame, words: DataFrame, known, texts: int) -> tuple[float, float]:
    """(A, K) of the greatest left-one-out likelihood of all training texts: sums over shards, and over words for A."""
    spark = grams.sparkSession

    def sums(terms, size):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for k, c in zip(batch.column(1), batch.column(2)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64()) for x in terms(Grams(k.as_py(), c.as_py(), known.value))], [f"t{i}" for i in range(size)])

        names = [f"t{i}" for i in range(size)]
        return list(grams.mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*(F.coalesce(F.sum(n), F.lit(0.0)) for n in names)).first())

    below = words.agg(*(F.coalesce(F.sum(F.col("c") * F.log(F.col("c") - 1 + a)), F.lit(0.0)) for a in STRENGTHS)).first()
    bigrams = sums(lambda g: g.strength_terms(), len(STRENGTHS))
    a = STRENGTHS[int(np.argmax([x - y - texts * math.log(texts - 1 + s) for x, y, s in zip(bigrams, below, STRENGTHS)]))]
    trigrams = sums(lambda g: g.trust_terms(a), len(TRUSTS))
    k = TRUSTS[int(np.argmax([x - texts * math.log(t * (texts - 1) + texts - 1 + a) for x, t in zip(trigrams, TRUSTS)]))]
    return a, k


def requests(docs: DataFrame, known, labels: list[int]) -> DataFrame:
    """(p, s, kind, a, b, c): of each block p a row for each shard with its n-grams (kind 0) and rare words (1), and one with the documents themselves (2).

    A request holds its distinct keys, how many documents hold each, and those documents with the occurrences in each.
    """
    shards = len(labels)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own, reader = known.value, Reader(known.value)
        number, held = TaskContext.get().partitionId() << 32, []
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        log_p, back, seen = np.log10(own.p(own.counts)), own.back(own.counts), own.counts > 0

        def grouped(keys, shard, doc):
            """Rows of the (key, document) pairs, in shards; documents come in order."""
            order = order_of(keys)
            keys, doc, shard = keys[order], doc[order], shard[order]
            new_key = new_values(keys)
            starts = np.flatnonzero(new_key | new_values(doc))
            times = np.diff(np.append(starts, len(keys))).astype(np.uint32)
            doc = doc[starts].astype(np.uint16)
            first = np.flatnonzero(new_key[starts])
            holders = np.diff(np.append(first, len(starts)))
            starts = starts[first]
            distinct, where = keys[starts], shard[starts]
            del keys, shard, new_key, starts
            order = np.argsort(where, kind="stable")
            for s, x in by_shard(where[order], shards):
                mine = order[x]
                n = holders[mine]
                spread = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                yield labels[s], packed(np.diff(distinct[mine], prepend=np.uint64(0))), packed(n.astype(np.uint32)), pack_parts([packed(doc[spread]), packed(times[spread])])

        def flush():
            nonlocal number
            ids, texts = [h[0] for h in held], [h[1] for h in held]
            held.clear()
            rows = [(number, s, 0, *x) for s, *x in grouped(*all_gram_keys(texts, shards))]
            line = np.concatenate(texts)
            doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            seldom = rare(line)
            if seldom.any():
                hashes = line[seldom]
                rows += [(number, s, 1, *x) for s, *x in grouped(hashes.view(np.uint64), (hashes % shards).astype(np.uint16 if shards < 1 << 16 else np.int64), doc[seldom])]
            plain, doc, n = line[~seldom], doc[~seldom], len(texts)
            add = lambda values, first: first + np.bincount(doc, values, n)
            local = np.zeros((n, 4))
            local[:, 0] = [len(t) + 1 for t in texts]
            local[:, 1] = add(seen[plain], float(seen[END]))
            local[:, 2] = add(log_p[plain], log_p[END])
            local[:, 3] = add(back[plain], back[START] + own.back2(own.texts, own.texts))  # the first token's context is two starts
            rows.append((number, labels[number % shards], 2, pa_bytes(pa.array(ids, kind_of_id)), local.tobytes(), None))
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["p", "s", "kind", "a", "b", "c"])

        n = 0
        for batch in batches:
            kind_of_id = batch.column(0).type
            for i, codes in zip(batch.column(0).to_pylist(), chain.from_iterable(map(reader.codes, binary_lists(batch.column(1))))):
                held.append((i, codes))
                n += len(codes) + 1
                if n > BLOCK or len(held) >= 60_000:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "p long, s int, kind int, a binary, b binary, c binary")


def distinct_keys(differences) -> np.ndarray:
    """The distinct ones, rising, of keys given as arrays of their differences."""
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(d) for d in differences)])
    keys.sort()
    return keys[new_values(keys)]


def answered(requested: DataFrame, grams: DataFrame, words: DataFrame, known, labels: list[int]) -> DataFrame:
    """(p, a, b): for each request the sums for its documents: their indices, scores, and of rare words base scores and known tokens; the documents' own rows as they are."""
    spark, shards = requested.sparkSession, len(labels)
    named = F.broadcast(spark.createDataFrame(list(enumerate(labels)), "n int, s int"))  # a row for each shard
    none = lambda kind: F.lit(None).cast(kind)
    of_words = words.withColumn("n", F.pmod("h", F.lit(shards)).cast("int")).join(named, "n").select("s", none("binary").alias("keys"), none("binary").alias("counts"), "h", "c")
    model = grams.select("s", "keys", "counts", none("long").alias("h"), none("long").alias("c")).union(of_words)

    def score(asked, held):
        import pyarrow as pa

        own = known.value
        found = [Grams(k, c, own) for k, c in zip(held.column("keys").to_pylist(), held.column("counts").to_pylist()) if k]
        tree = found.pop().trie(own) if found else None
        h = held.column("h").combine_chunks().drop_null().to_numpy()
        c = held.column("c").combine_chunks().drop_null().to_numpy()
        order = np.argsort(h.view(np.uint64))
        h, c = h.view(np.uint64)[order], c[order]
        every = distinct_keys(unpacked(a.as_py(), np.uint64) for kind, a in zip(asked.column("kind"), asked.column("a")) if not kind.as_py())
        weight = tree.weights(every) if tree else np.zeros(len(every))  # each n-gram is sought once, however many blocks ask for it
        out = []
        for p, kind, a, b, x in zip(*(asked.column(n) for n in ("p", "kind", "a", "b", "c"))):
            p, kind, a, b = p.as_py(), kind.as_py(), a.as_py(), b.as_py()
            if kind == 2:
                out.append((p, a, b))
                continue
            keys, holders = risen(a), unpacked(b, np.uint32).astype(np.int64)
            docs, times = (unpacked(d, k).astype(np.int64) for d, k in zip(parts_of(x.as_py()), (np.uint16, np.uint32)))
            index = np.repeat(np.arange(len(keys)), holders)
            n = int(docs.max()) + 1
            if kind == 0:
                weights = weight[np.searchsorted(every, keys)]
                sums = [np.bincount(docs, weights[index] * times, n), None, None]
            else:
                at = np.minimum(np.searchsorted(h, keys), max(0, len(h) - 1))
                count = np.where(h[at] == keys, c[at], 0) if len(h) else np.zeros(len(keys), np.int64)
                sums = [np.bincount(docs, x[index] * times, n) for x in (own.back(count), np.log10(own.p(count)), count > 0)]
            seen = np.flatnonzero(np.bincount(docs, minlength=n))
            columns = [packed(np.diff(seen, prepend=0).astype(np.uint16)), sums[0][seen].astype(np.float32).tobytes()]
            if kind:
                columns += [sums[1][seen].tobytes(), packed(sums[2][seen].astype(np.int32))]
            out.append((p, pack_parts(columns), None))
        return pa.table({"p": pa.array([o[0] for o in out], pa.int64()), "a": pa.array([o[1] for o in out], pa.binary()), "b": pa.array([o[2] for o in out], pa.binary())})

    return requested.groupBy("s").cogroup(model.groupBy("s")).applyInArrow(score, "p long, a binary, b binary")


def summed(answers: DataFrame, id_type: str) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) from the answers for each block."""

    def add(group):
        import pyarrow as pa

        rows = list(zip(group.column("a").to_pylist(), group.column("b").to_pylist()))
        ids, local = next((pa.ipc.open_stream(a).read_all().column(0).combine_chunks(), np.frombuffer(b).reshape(-1, 4).copy()) for a, b in rows if b is not None)
        for a, b in rows:
            if b is None:
                parts = parts_of(a)
                at = np.cumsum(unpacked(parts[0], np.uint16).astype(np.int64))
                local[at, 3] += np.frombuffer(parts[1], np.float32)
                if len(parts) > 2:
                    local[at, 2] += np.frombuffer(parts[2])
                    local[at, 1] += unpacked(parts[3], np.int32)
        local[:, 3] += local[:, 2]
        whole = local[:, :2].astype(np.int64)
        return pa.table({"doc_id": ids, "n_tokens": whole[:, 0], "n_known": whole[:, 1], "base_score": local[:, 2], "score": local[:, 3]})

    return answers.groupBy("p").applyInArrow(add, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, learn, size: int = COMMON, shards: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text), learning from the rows where learn holds.

    Null texts are empty: one end token. Repeated rows stay, and count as often as they occur. With no row to learn from,
    every word is unknown and the scores are those of the smoothing alone. size: words with broadcast counts, which
    changes no result but for n-grams of other words that share a key (about 1 % of those words in a full shard); shards: as many as the tokens need, if None.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    train = docs.where(learn)
    words = cut(word_counts(train.select("text")), "words")
    own, least = common_words(words, train.count(), size)
    labels = labels_of(spark, shards or shards_of(own.tokens, shuffle_partitions(spark)))
    known = spark.sparkContext.broadcast(own)
    grams = cut(gram_counts(train.select("text"), known, labels), "grams")
    if own.texts:
        own.strength, own.trust = fitted(grams, words, known, own.texts)
        known = spark.sparkContext.broadcast(own)
    answers = answered(requests(docs, known, labels), grams, words.where(F.col("c") < least), known, labels)
    scored = summed(answers, docs.schema["doc_id"].dataType.simpleString())
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(own.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = crc_of_id() % 7
    scored = score_texts(table(spark, sf_dir, "documents"), F.coalesce(remainder != 2, F.lit(True)))
    return scored.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
