"""Alignments of two tokenizers against a plain version that encodes whole texts and compares all byte ranges."""

import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import token_alignment as TA
from lodestone.llm.common import tokenizer_path

FOLDER = "/root/testdata/sf0.001"
PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb c", "x 　 y", "x  y", "café été naïve", "日本語 \U0001f600 ok", "▁x", "a ▁ b", "x▁ y", "<s> <unk> <|endoftext|> <0x0A>",
    "don't  we'll 12 345", "\x00 \x1c \x85 end", "tab\t tab \tx", "a" * 300, "word " * 300, "é e ́x", "\r\n \r\n", "end ", "​ ​", "  x", "ا1 ا",
]


@pytest.fixture(scope="module")
def plain():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}

    def one(text):
        """(tokens of A, tokens of B, groups, links) of a text, or None."""
        if not text:
            return None
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if {b"".join(x) for x in spelled} != {(" " + text).encode()}:
            return None
        spans = []
        for x in spelled:
            at, out = 0, []
            for s in x:
                out.append((at, at + len(s)))
                at += len(s)
            spans.append(out)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, at = [], [0, 0]
        for c in cuts:
            group = []
            for k in (0, 1):
                end = at[k]
                while spans[k][end][1] < c:
                    end += 1
                group.append(",".join(map(str, ids[k][at[k] : end + 1])))
                at[k] = end + 1
            groups.append("|".join(group))
        links, first = [], 0
        for i, (s, e) in zip(ids[0], spans[0]):
            while spans[1][first][1] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, ids[1][k]))
                k += 1
        return ids[0], ids[1], ";".join(groups), links

    def rows(docs):
        found = [(i, one(t)) for i, t in docs]
        count = Counter(p for _, x in found if x for p in set(x[3]))
        most = {}
        for (i, _), n in count.items():
            most[i] = max(n, most.get(i, 0))
        out = []
        for i, x in found:
            if x is None:
                out.append((i, 0, 0, 0, 0, 0, 0, "", ""))
            else:
                out.append((i, len(x[0]), len(x[1]), x[2].count(";") + 1, len(x[3]), sum(count[p] == most[p[0]] for p in x[3]), sum(count[p] for p in x[3]), hashlib.sha256(x[2].encode()).hexdigest(), x[2]))
        return sorted(map(repr, out)), {(*p, n, n == most[p[0]]) for p, n in count.items()}

    return rows


def listed(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_query(spark, plain):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    want = [repr(eval(r)[:-1]) for r in plain(docs)[0]]
    assert listed(TA.op13_token_alignment(spark, FOLDER)) == want


@pytest.mark.parametrize("sizes", [(TA.BLOCK_BYTES, TA.STEP_BYTES, TA.SLICE_BYTES, TA.MEMO), (50, 20, 16, 5)])
def test_odd_texts(spark, plain, monkeypatch, sizes):
    """Also with blocks, steps, slices and a memo so small that every text needs several."""
    for name, value in zip(("BLOCK_BYTES", "STEP_BYTES", "SLICE_BYTES", "MEMO"), sizes):
        monkeypatch.setattr(TA, name, value)
    rng = random.Random(3)
    signs = [" ", " ", " ", "\n", "a", "bc", "the", "é", "1", ".", "　", " ", "\t", "日", "'s", "́", "\x1f"]
    rows = [(i % 9 or None, t) for i, t in enumerate(ODD)] + [(100 + i, "".join(rng.choices(signs, k=rng.randint(1, 60)))) for i in range(300)]
    rows += rows[:3]
    al = TA.Aligner(*PATHS)
    assert al.splits
    block = TA.Block(al, True)
    for at in range(0, len(rows), 40):
        block.add([r[0] for r in rows[at : at + 40]], [(r[1] or "").encode() for r in rows[at : at + 40]])
    want, _ = plain(rows)
    got = sorted(repr((i, *r[:4], b";".join(r[5]).decode() if r[0] else "")) for i, r in zip(block.ids, block.rows))
    assert got == sorted(repr((*x[:5], x[8])) for x in map(eval, want))
    held, pairs, docs = block.held()
    assert {(int(p) >> al.shift, int(p) & (1 << al.shift) - 1, int(n)) for p, n in zip(pairs, docs)} == {x[:3] for x in plain(rows)[1]}


def test_operator(spark, plain):
    rows = [(i % 9 or None, t) for i, t in enumerate(ODD)] * 2 + [(50, "word, and " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, pairs int").repartition(5)
    want, counts = plain(rows)
    assert listed(TA.alignments(docs, *PATHS)) == want
    assert {tuple(r) for r in TA.pair_counts(docs, *PATHS).collect()} == counts
    named = docs.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"), F.lit(1).alias("doc_id"))
    assert TA.alignments(named, *PATHS, id_column="name", text_column="body").where("n_a > 0").count() == sum(eval(r)[1] > 0 for r in want)
    assert TA.alignments(docs.where(F.lit(False)), *PATHS).collect() == []


def test_whole_texts_where_cuts_are_not_proved(monkeypatch, plain):
    al = TA.Aligner(*PATHS)
    al.splits = False
    block = TA.Block(al, True)
    rows = list(enumerate(ODD))
    block.add([i for i, _ in rows], [(t or "").encode() for _, t in rows])
    assert sorted(repr((i, *r[:4], b";".join(r[5]).decode() if r[0] else "")) for i, r in zip(block.ids, block.rows)) == sorted(repr((*x[:5], x[8])) for x in map(eval, plain(rows)[0]))
