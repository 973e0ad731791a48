"""ROUGE-L queries against a plain longest common subsequence of whole texts."""

import collections

import duckdb
import numpy as np

from lodestone import plans
from lodestone.plans.views import CITED

FOLDER = "/root/testdata/sf0.001"


def plain_rouge(p, r):
    a, b = ((x or "").lower().split() for x in (p, r))
    ids = {w: k for k, w in enumerate({*a, *b})}
    other = np.array([ids[w] for w in b], np.int64)
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (other == ids[w])))
    n = int(row[-1])
    return round(2 * n / (len(a) + len(b)), 4) if n else 0.0


def test_n08_scores_whole_texts(spark):
    own = duckdb.execute(f"SELECT {CITED} || ' ' || text, text FROM '{FOLDER}/documents.parquet' WHERE doc_id % 10 <> 0").fetchall()
    scores = [plain_rouge(*x) for x in own]
    for r in plans.QUERIES["n08_rescore"](spark, FOLDER).collect():
        assert r.n == r.rouge_l_n == len(own) and abs(r.rouge_l - sum(scores) / len(scores)) < 1e-4


def test_t07_scores_every_reply(spark):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in duckdb.execute(f"SELECT conv_id, turn, role, text FROM '{FOLDER}/conversations.parquet' ORDER BY conv_id, turn").fetchall():
        turns[conv].append((turn, role, text))
    want = {(c, a[0]): plain_rouge(a[2], b[2]) for c, own in turns.items() for a, b in zip(own, own[1:]) if (a[1], b[1]) == ("user", "assistant")}
    got = {(r.conv_id, r.turn): r.rouge_l for r in plans.QUERIES["t07_rouge_l"](spark, FOLDER).collect()}
    assert len(want) > 20 and got == want
