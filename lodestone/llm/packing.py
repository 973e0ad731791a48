"""Vector bin packing of examples into training sequences by the dot-product heuristic.

An example demands tokens, one segment, and loss-bearing tokens; a sequence has a limit for each. The open sequence takes,
of the examples that fit, the one whose demand has the largest dot product with what is left of the sequence (both as
shares of the limits, weighted by mean demand). Each partition packs its own rows in blocks, so no shuffle is needed, a
rerun of a task gives the same sequences, and memory is bounded by one block. Documents may be cut: a sequence that has
all the segments it may have, but not all the tokens, is cut at a power of two, which needs no padding.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import binary_list, slices, table, tokenizer_path
from lodestone.llm.token_counts import PLAIN, PRE, count_tokens

BLOCK = 1024
MEMO = 1_000_000
#: Bytes of the longest piece that is kept in the memo.
LONG_PIECE = 64
#: Pieces that are encoded as one text.
JOINED = 512


def place(demand: np.ndarray, limits: np.ndarray, cut: bool = False) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, first token, tokens).

    demand: a row (tokens, segments, loss tokens) for each example. With cut, an example may be split to fill a
    sequence; its loss tokens are then taken to lie evenly, and its tokens and loss tokens must be equal or loss zero.
    Examples that exceed a limit alone (without cut) get a sequence of their own.
    """
    limits = np.asarray(limits, float)
    share = np.asarray(demand, float).reshape(-1, len(limits)) / limits
    first = np.zeros(len(share), np.int64)
    weight = share.mean(0) if len(share) else limits
    open_ = np.ones(len(share), bool)
    order = np.arange(len(share))
    out = []
    while open_.any():
        left = np.ones(len(limits))
        chosen: list[tuple[int, int, int]] = []
        own = order[open_]
        rows = share[own]
        free = np.ones(len(own), bool)
        while True:
            fits = free & (rows <= left + 1e-9).all(1)
            if not fits.any():
                break
            i = int(np.argmax(np.where(fits, rows @ (weight * left), -1.0)))
            free[i] = False
            left -= rows[i]
            tokens = round(rows[i, 0] * limits[0])
            chosen.append((int(own[i]), int(first[own[i]]), tokens))
            open_[own[i]] = False
        if not chosen and not cut:
            i = int(own[0])
            chosen, open_[i] = [(i, 0, round(share[i, 0] * limits[0]))], False
        room = round(left[0] * limits[0])
        if cut and free.any() and room > 0 and left[1] * limits[1] > 0.5:
            i = int(own[int(np.argmax(np.where(free, rows[:, 0], -1.0)))])
            chosen.append((i, int(first[i]), room))
            first[i] += room
            share[i, 0] -= room / limits[0]
            share[i, 2] = max(0.0, share[i, 2] - room / limits[2]) if share[i, 2] else 0.0
        out.append(chosen)
    return out


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes; pieces between white space are kept in a bounded memo."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)  # ids that end a pre-token
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.last[number] = token.endswith("</w>")
        self.ends = {c.encode(): array("I", self.tokenizer.encode(c, add_special_tokens=False).ids).tobytes() for c in ",."}

    def __call__(self, text: bytes) -> bytes:
        out = []
        for part in slices(text):
            words = (part if b"<|" in part else part.lower()).split()  # the tokenizer lower-cases too, but not what could be a special string
            if new := set(words).difference(self.memo):
                if len(self.memo) > MEMO:
                    self.memo.clear()
                    new = set(words)
                self.learn(new)
            out.append(b"".join(map(self.memo.__getitem__, words)))
            for w in new:
                if len(w) > LONG_PIECE:  # the memo is bounded in bytes, not in pieces alone
                    self.memo.pop(w, None)
                    self.memo.pop(w[:-1], None)
        return b"".join(out)

    def joined(self, block: list[tuple[bytes, str]]) -> list[tuple[bytes, str]]:
        """Encodes pieces as one text, cut after each piece's pre-tokens; pieces for which the cuts do not add up are given back."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(t for _, t in block)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        stops = np.cumsum([len(PRE.findall(t.lower())) for _, t in block]) - 1
        if stops[-1] != len(ends) - 1 or len(ids) != ends[-1]:
            return block
        raw, start = ids.tobytes(), 0
        for (word, _), stop in zip(block, (4 * ends[stops]).tolist()):
            self.memo[word], start = raw[start:stop], stop
        return []

    def learn(self, new: set[bytes]) -> None:
        """Encodes new pieces; a comma or full stop after an ASCII letter is a pre-token of its own, so it shares the ids of the piece before it."""
        ended = {w: w[:-1] for w in new if w[-1:] in (b",", b".") and w[-2:-1].isalpha()}
        odd, plain = [], []
        for word in (new.difference(ended) | {*ended.values()}).difference(self.memo):
            text = word.decode()
            if not PLAIN.fullmatch(text) or "<|" in text:
                odd.append((word, text))
            elif len(word) <= LONG_PIECE:
                plain.append((word, text))
            else:  # by its pre-tokens, of which a long piece repeats many
                parts = [t.encode() for t in PRE.findall(text.lower())]
                if len(parts) == 1:
                    odd.append((word, text))
                    continue
                self.learn(set(parts).difference(self.memo))
                self.memo[word] = b"".join(map(self.memo.__getitem__, parts))
        for at in range(0, len(plain), JOINED):
            odd += self.joined(plain[at : at + JOINED])
        for (word, _), e in zip(odd, self.tokenizer.encode_batch_fast([t for _, t in odd], add_special_tokens=False)):
            self.memo[word] = array("I", e.ids).tobytes()
        for word, start in ended.items():
            self.memo[word] = self.memo[start] + self.ends[word[-1:]]


@lru_cache(2)
def ids_of(path: str) -> Ids:
    return Ids(path)


class Sequences:
    """Packs the documents of one partition: full sequences from long documents at once, the rest in blocks."""

    def __init__(self, base: int, size: int, segments: int):
        self.next, self.size, self.limits = base, size, np.array([size, segments, size])
        self.waiting: list[tuple[object, int, bytes, int]] = []  # doc, start, ids, tokens of the document
        self.due = BLOCK

    def row(self, doc, start, ids, doc_tokens, offset):
        return doc, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, self.next, offset

    def add(self, doc, ids: bytes):
        total, step = len(ids) // 4, self.size * 4
        full = len(ids) // step
        for k in range(full):
            yield self.row(doc, k * self.size, ids[k * step : (k + 1) * step], total, 0)
            self.next += 1
        if tail := ids[full * step :]:
            self.waiting.append((doc, full * self.size, tail, total))
        if len(self.waiting) >= self.due:
            yield from self.pack(False)
            self.due = len(self.waiting) + BLOCK

    def emit(self, pieces: list, tokens: int):
        """The rows of a sequence with the first tokens of the pieces; returns what is left of them."""
        offset, left = 0, []
        for doc, start, ids, total in pieces:
            n = min(tokens - offset, len(ids) // 4)
            if n:
                yield self.row(doc, start, ids[: 4 * n], total, offset)
                offset += n
            if 4 * n < len(ids):
                left.append((doc, start + n, ids[4 * n :], total))
        self.next += 1
        return left

    def pack(self, last: bool):
        """Packs what waits. Sequences that are neither full nor have all their segments wait for the next block; at the last, they are cut at powers of two."""
        demand = np.array([[len(w[2]) // 4, 1, len(w[2]) // 4] for w in self.waiting]).reshape(-1, 3)
        kept = []
        for chosen in place(demand, self.limits, cut=True):
            used = sum(c[2] for c in chosen)
            pieces = [(self.waiting[i][0], self.waiting[i][1] + at, self.waiting[i][2][4 * at : 4 * (at + n)], self.waiting[i][3]) for i, at, n in chosen]
            if used == self.size or len(chosen) >= self.limits[1]:
                pieces = yield from self.emit(pieces, used if used == self.size else 1 << used.bit_length() - 1)
            kept += pieces
        self.waiting = kept
        while last and self.waiting:
            few, rest = self.waiting[: int(self.limits[1])], self.waiting[int(self.limits[1]) :]
            tokens = sum(len(w[2]) // 4 for w in few)
            left = yield from self.emit(few, min(self.size, 1 << tokens.bit_length() - 1))
            self.waiting = left + rest


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, size: int = 2048, segments: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every document's ids and end_id.

    segments: how many pieces a sequence may have, as many as it has tokens if None. A document without text (null or empty) is its end id alone. Repeated rows are packed as documents of their own. All
    ids of a document bear loss, so its loss-bearing tokens never limit a sequence before its tokens do (pack_examples has
    examples for which they do). Sequence ids hold the partition's number, so they are distinct without a shuffle.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        encode, own, key = ids_of(path), Sequences(TaskContext.get().partitionId() << 40, size, segments or size), None

        def out(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key), *(pa.array(c, pa.int64()) for c in cols[1:])], schema)

        for batch in batches:
            key, rows = batch.column(0).type, []
            for doc, text in zip(batch.column(0).to_pylist(), binary_list(batch.column(1))):
                rows += own.add(doc, encode(text or b"") + end)
            if rows:
                yield out(rows)
        if key is not None and (rows := list(own.pack(True))):
            yield out(rows)

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_examples(examples: DataFrame, limits: tuple[int, int, int] = (2048, 16, 1024), id_column: str = "example_id", tokens: str = "n_tokens", loss: str = "n_loss") -> DataFrame:
    """Instruction examples, never cut: (example_id, n_tokens, n_loss, sequence_id, offset, segment).

    limits: tokens, segments and loss-bearing tokens of a sequence. Null counts are zero; an example over a limit alone
    gets its own sequence, for the caller to see. Blocks of BLOCK examples are packed on their own.
    """
    kind = examples.schema[id_column].dataType.simpleString()
    names = ["example_id", "n_tokens", "n_loss", "sequence_id", "offset", "segment"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes = np.array([[t or 0, 1, n or 0] for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]).reshape(-1, 3)
            rows = []
            for at in range(0, len(ids), BLOCK):
                for chosen in place(sizes[at : at + BLOCK], np.array(limits)):
                    offset = 0
                    for k, (i, _, n) in enumerate(chosen):
                        rows.append((ids[at + i], n, int(sizes[at + i, 2]), number, offset, k))
                        offset += n
                    number += 1
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

    return examples.select(F.col(id_column), F.col(tokens).cast("long"), F.col(loss).cast("long")).mapInArrow(run, f"example_id {kind}, n_tokens long, n_loss long, sequence_id long, offset long, segment long")


def conversations_as_examples(turns: DataFrame, path: str, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(example_id, n_tokens, n_loss) of each conversation of turns (conv_id, role, text): the tokens of its turns, each with an end; only the turns of the roles learned bear loss. Null ids are one conversation, null texts are empty."""
    own = turns.select(F.struct("conv_id", "role").alias("of"), "text")
    counted = count_tokens(own, path, id_column="of").select("doc_id.conv_id", F.coalesce(F.col("doc_id.role").isin(*learned), F.lit(False)).alias("bears"), (F.col("n_tokens") + 1).alias("n"))
    return counted.groupBy(F.col("conv_id").alias("example_id")).agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0)).alias("n_loss"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in sequences of at most 2048 tokens, 16 examples and 1024 loss-bearing tokens."""
    return pack_examples(conversations_as_examples(table(spark, sf_dir, "conversations"), tokenizer_path("word_bpe_49k.json")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
