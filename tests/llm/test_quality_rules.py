"""Measurements against a plain count, the queries against their SQL, and policies and ablations against lists."""

import re
from collections import Counter
from functools import reduce
from operator import and_, or_

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality_rules as Q
from lodestone.llm import registry

FOLDER = "/root/testdata/sf0.001"
SPACE = " \t\n\r\x0b\x0c"
ODD = [None, "", " \n\t", "one two", "a b c a b c", "a a a a", "é\x0bü\nü", "x\n\nx\nX\n x\nx ", "##\n$ % & | < >*", "A B\tC D\nab", "a b c d", "日本 語 " * 30, "w " * 70_000, "a b c d e a b c d f", "\x00 \x1c \x85"]


def plain(text):
    text = text or ""
    words = [w for w in re.split(f"[{SPACE}]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    times = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i, x in enumerate(zip(words, words[1:], words[2:])) if times[x] > 1 for j in (i, i + 1, i + 2)}
    ascii_ = [c for c in text if c.isascii()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines), sum(c.isupper() for c in ascii_), sum(c.isalpha() for c in ascii_)


def test_measured():
    texts = [r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()] + ODD
    assert [tuple(x) for x in Q.measured([(t or "").encode() for t in texts]).tolist()] == [plain(t) for t in texts]


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = registry.QUERIES[name](spark, FOLDER)
    want = c.execute(Q.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i % 4 or None, t, "w", i) for i, t in enumerate(ODD)], "doc_id long, text string, failed string, n_words int")
    rows = Q.ledger(docs).collect()
    assert sorted(tuple(r[m] for m in Q.MEASURES) for r in rows) == sorted(map(plain, ODD))
    assert sum(r.doc_id is None for r in rows) == 4
    assert [r.failed for r in rows if r.n_words == 0] == [1, 1, 1]
    assert [tuple(r) for r in Q.kept(docs).collect()] == []
    long = docs.where(F.length("text") > 1000)
    kept = Q.kept(long.unionByName(long), Q.Policy("none", 1, ()))
    assert kept.columns == docs.columns and len({tuple(r) for r in kept.collect()}) == 1 and kept.count() == 2
    empty = docs.where(F.lit(False))
    assert Q.ledger(empty).count() == Q.ablations(Q.ledger(empty), Q.POLICIES["web", 2]).count() == 0
    clash = docs.select("doc_id", "text", F.col("failed").alias("grp"))
    assert [tuple(r) for r in Q.profile(Q.ledger(clash, ("grp",)), "grp").collect()] == [("w", len(ODD), reduce(or_, (r.failed for r in rows)), reduce(and_, (r.failed for r in rows)))]


def test_policies_read_bits_alone(spark):
    rows = spark.createDataFrame([(f,) for f in range(64)] * 2, "failed long")
    for policy in (*Q.POLICIES.values(), Q.Policy("all", 1, (), tuple(Q.RULES), 2)):

        def keeps(f, p=policy, but=None):
            failed = [r for r, b in Q.BITS.items() if f & b and r != but]
            return not set(failed) & set(p.required) and len(set(failed) & set(p.counted)) <= p.tolerated

        assert {r.failed: r.kept for r in Q.decided(rows, policy).collect()} == {f: keeps(f) for f in range(64)}
        used = policy.required + policy.counted
        seen = Q.mask(used)
        want = {(r, 128, 64, 2 * sum(f & seen == b for f in range(64)), 2 * sum(map(keeps, range(64))), 2 * sum(keeps(f, but=r) for f in range(64))) for r, b in Q.BITS.items() if r in used}
        assert {tuple(r) for r in Q.ablations(rows, policy).collect()} == want
    with pytest.raises(ValueError):
        Q.Policy("odd", 1, ("no such rule",))
    with pytest.raises(ValueError):
        Q.Policy("odd", 1, (), ("symbols",), -1)


def test_clean_documents_stay(spark):
    at = "/root/testdata/sf0.01"
    rows = Q.ledger(spark.read.parquet(f"{at}/documents.parquet")).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    long = rows.where(Q.POLICIES["base", 1].keeps(F.col("failed")))
    kept = {(r.quality, r.kept): r["count"] for r in Q.decided(long, Q.POLICIES["web", 2]).groupBy("quality", "kept").count().collect()}
    assert kept.get((1, False), 0) == 0 and kept.get((0, True), 0) <= 1
