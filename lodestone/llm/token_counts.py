"""Token counts with the whole-token shortcut.

A table made once per worker proves which vocabulary strings the tokenizer encodes alone as exactly one token. A text
is split at ASCII white space (no pre-token of this tokenizer spans white space); each piece is split into pre-tokens;
a pre-token in the table counts as one, and only the rest is merged by the library. Pieces outside a plain Latin range,
or with what could be a special string, go to the library whole. Counts of pieces are kept in a bounded memo.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import binary_list, slices, table, tokenizer_path

MEMO = 1_000_000
#: Bytes of the longest piece or pre-token that is kept in the memo.
LONG_PIECE = 64
#: Characters that are stable under NFC, lower-case one to one, and whose letters are exactly the class in PRE.
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class TokenCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = whole_tokens(self.tokenizer)
        self.pieces: dict[bytes, int] = {}
        self.merged: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        """Puts the counts of these pieces into the memo."""
        if len(self.merged) > MEMO:
            self.merged.clear()
        split, odd = {}, []
        for piece in new:
            text = piece.decode()
            if b"<|" in piece or not PLAIN.fullmatch(text):
                odd.append(piece)
            else:
                split[piece] = PRE.findall(text.lower())
        rest = [t for t in set(chain.from_iterable(split.values())) if t not in self.whole and t not in self.merged]
        self.merged.update(zip(rest, self.lengths(rest)))
        for piece, parts in split.items():
            self.pieces[piece] = sum(1 if t in self.whole else self.merged[t] for t in parts)
        for t in rest:
            if len(t) > LONG_PIECE:
                del self.merged[t]
        self.pieces.update(zip(odd, self.lengths([p.decode() for p in odd])))

    def count_batch(self, texts: list[bytes]) -> list[int]:
        out = []
        for text in texts:
            total = 0
            for part in slices(text):
                words = part.split()
                if new := set(words).difference(self.pieces):
                    if len(self.pieces) > MEMO:
                        self.pieces.clear()
                        new = set(words)
                    self.learn(list(new))
                total += sum(map(self.pieces.__getitem__, words))
                for w in new:
                    if len(w) > LONG_PIECE:  # the memo is bounded in bytes, not in pieces alone
                        del self.pieces[w]
            out.append(total)
        return out


def whole_tokens(tokenizer) -> frozenset[str]:
    """The vocabulary strings that end a word and, encoded alone, are that one token: found by encoding each of them."""
    letters = _byte_letters()
    candidates = {}
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if token.endswith("</w>"):
            try:
                text = bytes(letters[c] for c in token[:-4]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            candidates[text] = number
    texts = list(candidates)
    encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, encoded) if e.ids == [candidates[t]])


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the others count up from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; null texts count as empty, repeated rows give repeated rows.

    path: a tokenizers .json file with words that end in </w>, present on every worker. No shuffle; memory is bounded by the memo and one Arrow batch.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        own = counter(path)
        for batch in batches:
            texts = [t or b"" for t in binary_list(batch.column(1))]
            counts = own.count_batch(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
