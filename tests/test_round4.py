"""Odd inputs of the fourth review, and the whole job of r11_metrics."""

import math

from test_round3 import like_sql, written

from lodestone import plans

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def document(key, text, lang="en", source="src1"):
    return key, text, lang, source, None if text is None else len(text)


def test_corpus_issues_of_blank_and_very_long_documents(spark, tmp_path):
    """Documents without lines, without a language or source, with more lines than child ids have digits for, and with white space that only one engine calls so."""
    texts = [None, "", " \n ", " \n　  \na", "one\n\ntwo"]
    rows = [document(5 * i + j, text) for i in range(36) for j, text in enumerate(texts)]  # every case of the rules on ids
    rows += [document(-i, "a\nb") for i in (1, 2, 7, 23, 40)] + [document(None, "x" * 1_001, "en", None)]
    rows += [document(1_001 + i, "a", lang, source) for i, (lang, source) in enumerate([(None, "src"), (" ", None), ("en", "Article 4"), ("en", "4.1"), ("", ""), (None, " ARTICLE")] * 3)]
    rows += [document(k, "\n".join(["a"] * 10_001)) for k in (1_201, 1_207, 1_240)]
    rows += [document(1_301, "\n".join([" ".join("a" * 20) + gap + "b" for gap in "\x0b\x0c\r\t\x1c  "] * 9)), (1_302, "a", "en", "src", None), (1_303, "a", "en", "src", 9_001)]
    folder = written(spark, tmp_path / "t", documents=(rows, DOCUMENTS))
    like_sql(spark, folder, "f05_corpus_issues", ["documents"])


def test_corpus_issues_of_no_documents(spark, tmp_path):
    like_sql(spark, written(spark, tmp_path / "t", documents=([], DOCUMENTS)), "f05_corpus_issues", ["documents"])


def test_metrics_at_every_cutoff(spark, tmp_path):
    """Gold of a known rank counts from that cutoff on, in its split and in all; a question that no document holds does not."""
    ranks = dict(enumerate([1, 2, 3, 4, 8, 10, 13]))
    docs, items = [], [(7, "held by no document")]
    for item, rank in ranks.items():
        words = [f"{w}{item}" for w in ("alpha", "beta", "gamma", "delta")]
        items.append((item, " ".join(words)))
        docs += [document(100 * item + i, " ".join(2 * words[::-1])) for i in range(rank - 1)]  # all words twice, in another order
        docs.append(document(100 * item + 99, " ".join(words + 30 * ["filler"])))
    folder = written(spark, tmp_path / "t", documents=(docs, DOCUMENTS), benchmark=(items, "item_id long, text string"))
    got = {(r.split, r.k): (r.n, r.any_gold_recall, r.mrr, r.ndcg) for r in plans.QUERIES["r11_metrics"](spark, folder).collect()}
    want = {}
    for split, own in {"development": [0, 2, 4, 6], "test": [1, 3, 5], None: ranks}.items():
        for k in (1, 3, 5, 10, 20):
            found = [ranks[i] for i in own if ranks[i] <= k]
            want[split, k] = (len(own), *(round(x / len(own), 6) for x in (len(found), sum(1 / r for r in found), sum(1 / math.log2(r + 1) for r in found))))
    assert got == want
