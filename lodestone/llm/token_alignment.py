"""Alignment of the tokens of two tokenizers, and how many documents hold each pair of overlapping tokens.

Both tokenizers give the same bytes, so tokens are aligned by byte offsets: cumulated lengths are token ends, ends that
both have are cuts, and the cuts number the groups. Each token of A is linked with the tokens of B whose bytes it
overlaps.

A text is cut before spaces where both tokenizers end a token whatever stands around (see Aligner), so each distinct
piece is encoded and aligned once and kept in a bounded memo; a text is then a list of pieces. Documents are worked on
in blocks; a block sends each distinct pair once, with its number of documents. Counts are summed in two shuffles, the
first by pair and salt, so that no task gets all blocks of one pair. The counts go back to the blocks, not to documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import SLICE_BYTES, binary_list, cut, table, tokenizer_path
from lodestone.llm.packed import pack_parts, packed, parts_of, unpacked
from lodestone.llm.token_counts import _byte_letters

#: Bytes of text of a block, and of what is worked on at once in it.
BLOCK_BYTES, STEP_BYTES = 8 << 20, 4 << 20
#: The memo begins anew beyond so many pieces, or so many bytes of pieces.
MEMO, MEMO_BYTES = 250_000, 16 << 20
#: Salts of a pair in the first shuffle.
SALTS = 16


class Aligner:
    """Two tokenizers and the memo of aligned pieces.

    A piece is what follows a space. Both end a token before a space if the character before it is no white space and
    the one after it is no space: A's pre-tokens hold white space only at their start or alone, and B has no vocabulary
    string with a space after another character, so nothing is merged across. Both are looked up in the files; where one
    does not hold, texts are encoded whole.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters, size_a, size_b = _byte_letters(), self.a.get_vocab_size(), self.b.get_piece_size()
        spelled = [self.a.id_to_token(i) or "" for i in range(size_a)]
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in spelled]
        pieces = [self.b.id_to_piece(i) for i in range(size_b)]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.shift = (size_b - 1).bit_length()
        self.lengths = [np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b)]
        self.numbers = [str(i).encode() for i in range(max(size_a, size_b))]
        pre = json.loads(self.a.to_str())
        plain = pre["normalizer"] is None and pre["pre_tokenizer"].get("use_regex") is True and pre["pre_tokenizer"].get("add_prefix_space") is False
        self.splits = plain and not any("▁" in p.lstrip("▁") for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = 0
        self.groups: list[bytes] = []
        #: For each piece: tokens of A, tokens of B, groups, links, place of its links, whether it has no tokens, whether no cut may follow it.
        self.facts = np.zeros((0, 7), np.int64)
        self.links = np.zeros(0, np.int64)

    def learn(self, new: list[bytes]) -> None:
        texts = [p.decode() for p in new]
        tokens_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        tokens_b = self.b.encode(texts, num_threads=1)
        facts = np.zeros((len(new), 7), np.int64)
        for i, (piece, text, a, b) in enumerate(zip(new, texts, tokens_a, tokens_b)):
            whole = b" " + piece
            if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
                facts[i, 5], tokens_a[i], tokens_b[i] = 1, [], []
            facts[i, 6] = not text or text[-1].isspace()
        groups, links = self.align(tokens_a, tokens_b, facts)
        facts[:, 4] = len(self.links) + np.cumsum(facts[:, 3]) - facts[:, 3]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.size += sum(map(len, new))
        self.groups += groups
        self.facts = np.concatenate([self.facts, facts])
        self.links = np.concatenate([self.links, links])

    def align(self, tokens_a: list[list[int]], tokens_b: list[list[int]], facts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The groups of each piece as text, and the links of all as pairs; fills facts. All pieces are one text here: each ends with a cut."""
        facts[:, 0], facts[:, 1] = [len(x) for x in tokens_a], [len(x) for x in tokens_b]
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(facts[:, k].sum())) for k, x in enumerate((tokens_a, tokens_b)))
        long_a = self.lengths[0][ids_a]
        ends_a, ends_b = np.cumsum(long_a), np.cumsum(self.lengths[1][ids_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        first = np.searchsorted(ends_b, ends_a - long_a, side="right")
        times = np.searchsorted(ends_b, ends_a) - first + 1
        link_a = np.repeat(np.arange(len(ids_a)), times)
        link_b = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(len(link_a))
        pairs = ids_a[link_a] << self.shift | ids_b[link_b]
        label_a, label_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        numbers = np.arange(len(cuts) + 1)
        from_a, from_b = np.searchsorted(label_a, numbers).tolist(), np.searchsorted(label_b, numbers).tolist()
        said_a, said_b = ([self.numbers[i] for i in ids.tolist()] for ids in (ids_a, ids_b))
        said = [b",".join(said_a[i:j]) + b"|" + b",".join(said_b[k:m]) for i, j, k, m in zip(from_a, from_a[1:], from_b, from_b[1:])]
        upto_a = np.concatenate([[0], np.cumsum(facts[:, 0])])
        group_at = np.concatenate([label_a, [len(cuts)]])[upto_a]
        link_at = np.concatenate([[0], np.cumsum(times)])[upto_a]
        facts[:, 2], facts[:, 3] = np.diff(group_at), np.diff(link_at)
        at = group_at.tolist()
        return [b";".join(said[i:j]) for i, j in zip(at, at[1:])], pairs

    def numbered(self, lists: list[list[bytes]]) -> list[np.ndarray]:
        """The pieces of every list by their place in the memo."""
        every = set(chain.from_iterable(lists))
        new = every.difference(self.known)
        if new and (len(self.known) + len(new) > MEMO or self.size > MEMO_BYTES):
            self.clear()
            new = every
        if new:
            self.learn(sorted(new))
        return [np.fromiter(map(self.known.__getitem__, x), np.int64, len(x)) for x in lists]

    def cut_right(self, lists: list[list[bytes]]) -> tuple[list[list[bytes]], list[np.ndarray]]:
        """lists with pieces joined again that may not be cut apart, and their places in the memo."""
        found = self.numbered(lists)
        wrong = [i for i, x in enumerate(found) if self.facts[x[:-1], 6].any() or lists[i][-1] == b""]
        if not wrong:
            return lists, found
        lists = list(lists)
        for i in wrong:
            lists[i] = joined(lists[i])
        return lists, self.numbered(lists)


def joined(pieces: list[bytes]) -> list[bytes]:
    """Pieces with those joined again between which no cut is allowed: after white space, and before nothing."""
    runs = [[pieces[0]]]
    for piece in pieces[1:]:
        before = runs[-1][-1]
        if piece and before and not before[-4:].decode(errors="ignore")[-1:].isspace():
            runs.append([piece])
        else:
            runs[-1].append(piece)
    return [b" ".join(x) for x in runs]


def units(text: bytes, splits: bool) -> Iterator[list[bytes]]:
    """The pieces of a text that are not empty, long ones in several lists. Lists are cut before a space between an ASCII letter, digit or sign and something else than a space."""
    if not splits:
        yield [text]
        return
    at = 0
    while len(text) - at > SLICE_BYTES:
        end = text.find(b" ", at + SLICE_BYTES)
        while 0 <= end < len(text) - 1 and not (0x20 < text[end - 1] < 0x7F and text[end + 1] != 0x20):
            end = text.find(b" ", end + 1)
        if not 0 <= end < len(text) - 1:
            break
        yield text[at:end].split(b" ")
        at = end + 1
    yield text[at:].split(b" ")


class Block:
    """Documents of one task: their counts, digests and the links of each."""

    def __init__(self, aligner: Aligner, spelled: bool):
        self.aligner, self.spelled = aligner, spelled
        self.rows: list[list] = []  # n_a, n_b, n_groups, n_links, digest, groups
        self.ids: list = []
        self.size = 0
        self.keys, self.times = [], []  # number of the document << 40 | pair, and how often it is linked there

    def add(self, ids: list, texts: list[bytes]) -> None:
        first = len(self.rows)
        self.rows += [[0, 0, 0, 0, hashlib.sha256(), []] for _ in texts]
        self.ids += ids
        self.size += sum(map(len, texts))
        lost: set[int] = set()
        held, owners, size = [], [], 0
        for i, text in enumerate(texts):
            for pieces in units(text, self.aligner.splits) if text else ():
                held.append(pieces)
                owners.append(first + i)
                size += sum(map(len, pieces)) + len(pieces)
                if size > STEP_BYTES:
                    self.step(held, owners, lost)
                    held, owners, size = [], [], 0
        self.step(held, owners, lost)
        for i in lost:
            self.rows[i] = [0, 0, 0, 0, None, []]
        if lost:
            gone = np.array(sorted(lost))
            stay = [~np.isin(k >> 40, gone) for k in self.keys]
            self.keys, self.times = ([x[s] for x, s in zip(own, stay)] for own in (self.keys, self.times))

    def step(self, held: list[list[bytes]], owners: list[int], lost: set[int]) -> None:
        if not held:
            return
        al = self.aligner
        _, found = al.cut_right(held)
        sizes = np.array([len(x) for x in found])
        pieces, each = np.concatenate(found), np.repeat(owners, sizes)
        facts = al.facts[pieces]
        lost.update(each[facts[:, 5] > 0].tolist())
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(facts[:, :4], axis=0)])
        ends = np.cumsum(sizes)
        for owner, own, total in zip(owners, found, (sums[ends] - sums[ends - sizes]).tolist()):
            row = self.rows[owner]
            said = b";".join(map(al.groups.__getitem__, own.tolist()))
            row[4].update(b";" + said if row[0] else said)
            if self.spelled:
                row[5].append(said)
            for k in range(4):
                row[k] += total[k]
        times = facts[:, 3]
        at = np.repeat(facts[:, 4] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        keys, n = np.unique(np.repeat(each, times) << 40 | al.links[at], return_counts=True)
        self.keys.append(keys)
        self.times.append(n)

    def held(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The links of all documents as numbers of the block's pairs, the pairs, and the number of documents of each."""
        keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
        times = np.concatenate([np.zeros(0, np.int64), *self.times])
        if (np.diff(keys) <= 0).any():  # a document that was taken in several steps
            keys, own = np.unique(keys, return_inverse=True)
            times = np.bincount(own, weights=times, minlength=len(keys)).astype(np.int64)
        owners = keys >> 40
        pairs, number, docs = np.unique(keys & (1 << 40) - 1, return_inverse=True, return_counts=True)
        sizes = np.bincount(owners, minlength=len(self.rows))
        return pack_parts([packed(x.astype(np.uint32)) for x in (sizes, number, times)]), pairs, docs


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _blocks(docs: DataFrame, path_a: str, path_b: str, spelled: bool, id_column: str, text_column: str) -> DataFrame:
    """A written table with a row for each document (at: its number in the block), and one for each block, which has its links, pairs and numbers of documents."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"block long, at int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, held binary, pairs array<long>, docs array<long>"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        al, number, block = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, None
        names = ["block", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "held", "pairs", "docs"]

        def rows(block, number, id_type):
            n = len(block.rows)
            held, pairs, docs = block.held()
            digests = [r[4].hexdigest() if r[0] else "" for r in block.rows]
            spelled_ = [b";".join(r[5]).decode() if r[0] else "" for r in block.rows] if block.spelled else [None] * n
            yield [pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(block.ids, id_type), *(pa.array([r[k] for r in block.rows], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(spelled_, pa.string()), pa.nulls(n, pa.binary()), *(pa.nulls(n, pa.list_(pa.int64())),) * 2]
            yield [pa.array([number], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, id_type), *(pa.nulls(1, pa.int64()),) * 4, *(pa.nulls(1, pa.string()),) * 2, pa.array([held], pa.binary()), *(pa.array([x], pa.list_(pa.int64())) for x in (pairs, docs))]

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, texts = part.column(0).to_pylist(), [t or b"" for t in binary_list(part.column(1))]
                while texts:
                    block = block or Block(al, spelled)
                    total, n = block.size, 0
                    while n < len(texts) and (not n or total < BLOCK_BYTES):
                        total += len(texts[n])
                        n += 1
                    block.add(ids[:n], texts[:n])
                    ids, texts = ids[n:], texts[n:]
                    if block.size >= BLOCK_BYTES:
                        yield from (pa.RecordBatch.from_arrays(x, names) for x in rows(block, number, id_type))
                        block, number = None, number + 1
        if block:
            yield from (pa.RecordBatch.from_arrays(x, names) for x in rows(block, number, id_type))

    return cut(docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, schema), "aligned")


def _counted(blocks: DataFrame, shift: int) -> tuple[DataFrame, DataFrame]:
    """(block, pair) of all blocks, and (pair, n_docs, best) of all pairs."""
    each = blocks.where("pairs IS NOT NULL").select("block", F.inline(F.arrays_zip("pairs", "docs"))).withColumnRenamed("pairs", "pair")
    salted = each.groupBy("pair", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("docs").alias("docs"))
    counts = cut(salted.groupBy("pair").agg(F.sum("docs").alias("n_docs")), "pairs").withColumn("a", F.shiftright("pair", shift))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row for each entry of A's vocabulary at most
    return each.select("block", "pair"), counts.join(F.broadcast(most), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(token_a, token_b, n_docs, best) of all pairs of ids that overlap in some document: how many documents hold the pair, and whether that is the most of token_a."""
    shift = aligner(path_a, path_b).shift
    counts = _counted(_blocks(docs, path_a, path_b, False, id_column, text_column), shift)[1]
    return counts.select(F.shiftright("pair", shift).alias("token_a"), F.col("pair").bitwiseAND(F.lit((1 << shift) - 1)).alias("token_b"), "n_docs", "best")


def alignments(docs: DataFrame, path_a: str, path_b: str, spelled: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups.

    path_a: a tokenizers .json file of a byte-level vocabulary; path_b: a sentencepiece .model file that adds a space
    before the text; both on every worker. groups: the ids of A and B of each group, `a1,a2|b1;a3|b2,b3` (null unless
    spelled), and groups_sha256 its digest. n_best: links whose pair is the one of its A id that most documents hold,
    ties included; count_sum: the number of documents of each link's pair, summed over links. Null and empty texts, and
    those of which a tokenizer gives other bytes, have no tokens: zeros and ''. Repeated rows are documents of their
    own. An empty table gives none. A task holds a block of 8 MB of texts, or one longer text in steps of 4 MB.
    """
    import pyarrow as pa

    blocks = _blocks(docs, path_a, path_b, spelled, id_column, text_column)
    each, counts = _counted(blocks, aligner(path_a, path_b).shift)
    back = each.join(counts, "pair").select(F.col("block").alias("of"), "pair", "n_docs", "best")
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.filter(pa.compute.is_valid(left["at"]))
        held = left.filter(pa.compute.is_null(left["at"]))["held"].to_pylist()[0]
        sizes, number, times = (unpacked(x, np.uint32).astype(np.int64) for x in parts_of(held))
        order = np.argsort(right["pair"].to_numpy())
        if len(order) != (number.max(initial=-1) + 1):
            raise ValueError("pairs of a block without a count")
        n, best = right["n_docs"].to_numpy()[order][number], right["best"].to_numpy()[order][number]
        at = own["at"].to_numpy()
        ends = np.cumsum(sizes)

        def total(values):
            sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            return pa.array((sums[ends] - sums[ends - sizes])[at])

        return pa.table([*(own[c] for c in names), total(times * best), total(times * n), own["groups_sha256"], own["groups"]], names=[*names, "n_best", "count_sum", "groups_sha256", "groups"])

    left = blocks.select("block", "at", *names, "groups_sha256", "groups", "held")
    return left.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(finish, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignments(table(spark, sf_dir, "documents"), *paths, spelled=False).drop("groups")
