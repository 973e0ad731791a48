"""Runs of words against a plain search, and the query against a plain version of its contract."""

import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import periodic_runs
from lodestone.llm.word_ids import numbered

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(w[i : i + length - p] == w[i + p : i + length] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = WORD.findall((text or "").encode())
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return doc_id, len(runs), s, length, q, None if q is None else 1000 * length // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_runs_of(seed):
    rng = random.Random(seed)
    for _ in range(200):
        docs = []
        for _ in range(rng.randint(0, 4)):
            w = [b"%d" % rng.randint(0, rng.choice([0, 1, 2, 4, 30])) for _ in range(rng.randint(0, 70))]
            a, p = rng.randint(0, 20), rng.randint(1, 12)
            docs.append(w[:a] + w[a : a + p] * rng.randint(1, 9) + w[a + p :])
        ids, starts, counts = numbered(docs)
        got = [x.tolist() for x in periodic_runs.runs_of(ids, counts)]
        assert list(zip(*got)) == [(int(starts[d]) + a, b, q) for d, w in enumerate(docs) for a, b, q in plain_runs(w)]


def test_long_runs():
    for words, run in (([b"a"] * 100_000, (0, 100_000, 1)), ([b"%d" % (i % 999) for i in range(50_000)], (0, 50_000, 999))):
        ids, _, counts = numbered([words])
        assert [x.tolist() for x in periodic_runs.runs_of(ids, counts)] == [[x] for x in run]


def test_chunks_of_candidates(monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK", 7)
    w = [b"%d" % (i % 5) for i in range(60)] + [b"x"] * 9
    ids, _, counts = numbered([w])
    assert list(zip(*(x.tolist() for x in periodic_runs.runs_of(ids, counts)))) == plain_runs(w)


def test_query(spark):
    rows = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {tuple(r) for r in periodic_runs.op12_periodic_runs(spark, FOLDER).collect()}
    assert got == {plain_row(r["doc_id"], r["text"]) for r in rows}


def test_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, " \t\n "), (None, "a b"), (4, "x " * 5), (5, "x " * 6), (5, "x " * 6), (6, "é é é é é é\x0bé"), (7, "a b " * 50_000 + "c"), (8, "a a " * 8), (30, "one"), (None, None)]
    docs = spark.createDataFrame([(i, t, "r", 0) for i, t in odd], "doc_id long, text string, runs string, collapsed int")
    found = periodic_runs.digests(periodic_runs.periodic_runs(docs))
    got = sorted(map(repr, (tuple(r) for r in found.collect())))
    want = []
    for i, t in odd:  # without planting
        runs = plain_runs(WORD.findall((t or "").encode())) if len(t or "") < 10_000 else [(0, 100_000, 2)]
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        words = WORD.findall((t or "").encode())
        gone = {k for a, b, c in runs for k in range(a + c, a + b)}
        kept = b" ".join(x for k, x in enumerate(words) if k not in gone)
        want.append(repr((i, len(runs), s, length, q, None if q is None else 1000 * length // q, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())))
    assert got == sorted(want)
    many = [(i, " ".join(random.Random(i).choices("abc", k=40))) for i in range(60)] + [(60, None), (61, ""), (62, "a")]
    planted = periodic_runs.planted(spark.createDataFrame(many, "doc_id long, text string"))
    assert {tuple(r) for r in periodic_runs.digests(periodic_runs.periodic_runs(planted)).collect()} == {plain_row(*r) for r in many}
    assert periodic_runs.planted(spark.createDataFrame([(None, "a a a a a a a")], "doc_id long, text string")).first().text == "a a a a a a a"
    assert periodic_runs.digests(periodic_runs.periodic_runs(docs.where(F.lit(False)))).count() == 0
