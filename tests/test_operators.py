"""Operators on small fixed tables."""

import collections
import hashlib
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import stats
from lodestone.functions import text as T
from lodestone.functions.python_text import rouge_l, typographic_normal
from lodestone.operators import answers, baselines, calibration, cells, citations, context, mapping, providers, relational, retrieval, review, splits
from lodestone.plans import commands, flows
from lodestone.sources import files, manifested, shared
from lodestone.streaming import votes as stream


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def lit(x):
    return F.lit(x)


def test_text_functions(spark):
    assert one(spark, T.lexical_tokens(lit("Article 4(6)(a)"))) == ["article", "4", "6", "a"]
    assert one(spark, T.normalize_text(lit("Article 4(1)(a) — Test"))) == "article 4 1 a test"
    assert one(spark, T.slug(lit(" Some – other — Title! "))) == "SOME_OTHER_TITLE"
    assert [one(spark, T.marker_value(lit(x))) for x in ("1.2 x", "(3) x", "(B) x", "(iv) x", "x", "12x")] == ["1.2", "3", "b", "iv", None, None]
    assert one(spark, T.citation_score(lit("Section 3.1"), lit("GM 3.1 (a)"))) == 0.6
    assert one(spark, T.map_decision(lit("Accepter avec correction, oui / Accept with correction"))) == "correct"
    assert one(spark, T.evidence_sets(lit("a; b"), lit('[["c","c"]]'), True)) == [["a", "b"], ["c"]]
    assert one(spark, T.evidence_sets_of_json(lit('[["c", 3]]'))) is None and one(spark, T.evidence_sets_of_json(lit("[[]]"))) is None
    assert one(spark, T.match_normal(typographic_normal(lit("“Straße” — the ﬁrst…")))) == "strasse the first"
    assert one(spark, T.text_digest(F.array(lit("a"), lit("b")))) == __import__("hashlib").sha256(b"a\0b\0").hexdigest().upper()
    assert one(spark, rouge_l(lit("a b c d"), lit("A c d e"))) == 0.75


def test_statistics(spark):
    assert [round(one(spark, x), 4) for x in stats.wilson(lit(8), lit(19))] == [0.2314, 0.6372]
    assert [one(spark, x) for x in stats.wilson(lit(0), lit(0))] == [0.0, 1.0]
    assert one(spark, stats.required_sample(lit(9 / 42), lit(0.42))) == 80 and one(spark, stats.required_sample(lit(0.5), lit(0.4))) is None
    assert one(spark, stats.lower_percentile(F.sequence(lit(1), lit(98)), 0.95)) == 93
    rated = [(i, c) for i, cs in enumerate(("aa", "ab", "bb")) for c in cs]
    assert round(review.fleiss_kappa(spark.createDataFrame(rated, "item int, category string")).first().kappa, 9) == round(1 / 3, 9)
    assert review.fleiss_kappa(spark.createDataFrame([(1, "a"), (1, "a")], "item int, category string")).first().kappa is None
    assert review.cohen_kappa(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "a string, b string")).first().kappa == 0.5
    won = review.majority(spark.createDataFrame([(1, "accept"), (1, "accept"), (1, "correct"), (2, "accept"), (2, "correct")], "q int, value string"), ["q"])
    assert {r.q: (r.winner, r.contested) for r in won.collect()} == {1: ("accept", False), 2: ("accept", True)}


def test_bm25(spark):
    docs = spark.createDataFrame([("A", "Article 4 mandatory occurrence reporting"), ("B", "Article 16 protection of information source"), ("C", "Annex risk classification")], "id string, text string")
    ask = spark.createDataFrame([("q", "Who must make a mandatory occurrence report?"), ("z", "unknown")], "qa_id string, question string")
    got = retrieval.bm25(ask, docs, 2).collect()
    assert [r.id for r in sorted((r for r in got if r.qa_id == "z"), key=lambda r: r.rank)] == ["A", "B"]
    assert next(r for r in got if r.qa_id == "q" and r.rank == 1).id == "A" and len([r for r in got if r.qa_id == "q"]) == 2
    for bad in ({"limit": 0}, {"k1": 0}, {"b": 2}):
        with pytest.raises(ValueError):
            retrieval.bm25(ask, docs, **bad)
    with pytest.raises(ValueError):
        retrieval.bm25(ask, docs.where("false"))


def test_cosine_and_fusion(spark):
    docs = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0]), ("C", [1.0, 1.0])], "id string, embedding array<float>")
    ask = spark.createDataFrame([("q", [1.0, 0.0])], "q string, embedding array<float>")
    assert [r.id for r in retrieval.cosine_top_k(ask, docs, 3).orderBy("rank").collect()] == ["A", "C", "B"]
    with pytest.raises(Exception, match="zero vector"):
        retrieval.cosine_top_k(ask, docs.withColumn("embedding", F.array(lit(0.0), lit(0.0))), 3).collect()
    rows = [(n, 1.0, "q", i, x) for n, ids in (("a", "ABC"), ("b", "CBD")) for i, x in enumerate(ids, 1)]
    schema = "ranker string, weight double, qa_id string, rank int, id string"
    assert [r.id for r in retrieval.reciprocal_rank_fusion(spark.createDataFrame(rows, schema), 60, 4).orderBy("rank").collect()] == ["C", "B", "A", "D"]
    twice = [("a", 1.0, "q", i, x) for i, x in enumerate("AAB", 1)]
    assert {r.id: round(r.score, 6) for r in retrieval.reciprocal_rank_fusion(spark.createDataFrame(twice, schema), 0).collect()} == {"A": 1.0, "B": 0.333333}
    tied = spark.createDataFrame([("q", "x", 1, 2.0), ("q", "y", 2, 2.0), ("q", "z", 3, 5.0)], "qa_id string, id string, original_rank int, score double")
    assert [r.id for r in retrieval.rerank(tied).orderBy("rank").collect()] == ["z", "x", "y"]


def test_metrics(spark):
    qa = spark.createDataFrame([("Q1", "test", [["C1", "C2"]], ["P1"]), ("Q2", "test", [["C3"]], ["P2"])], "qa_id string, split string, evidence_sets array<array<string>>, parent_ids array<string>")
    ranked = spark.createDataFrame([(q, i, c) for q, cs in (("Q1", ["C9", "C1", "C2"]), ("Q2", ["C4", "C3", "C8"])) for i, c in enumerate(cs, 1)], "qa_id string, rank int, id string")
    parents = spark.createDataFrame([("C1", "P1"), ("C2", "P1"), ("C3", "P2"), ("C4", "P2"), ("C8", "P8"), ("C9", "P9")], "id string, parent_id string")
    got = {r.k: r for r in retrieval.evaluate(qa, ranked, parents, [1, 3]).where("split IS NULL").collect()}
    assert (got[1].parent_recall, got[1].any_gold_recall) == (0.5, 0.0)
    assert (got[3].parent_recall, got[3].any_gold_recall, got[3].evidence_recall, got[3].mrr) == (1.0, 1.0, 1.0, 0.5)
    either = qa.limit(1).withColumn("evidence_sets", F.array(F.array(lit("C1"), lit("C2")), F.array(lit("C3"))))
    only = spark.createDataFrame([("Q1", 1, "C3")], "qa_id string, rank int, id string")
    best = retrieval.evaluate(either.withColumn("parent_ids", F.array(lit("P2"))), only, parents, [1]).first()
    assert (best.evidence_recall, best.mrr, best.ndcg, best.parent_recall) == (1.0, 1.0, 1.0, 1.0)
    with pytest.raises(Exception, match="no acceptable evidence"):
        retrieval.evaluate(qa.withColumn("evidence_sets", F.array().cast("array<array<string>>")), ranked, parents, [1]).collect()


def bundle(spark, ranks, words, **config):
    kids = spark.createDataFrame([(c, p, i, words.get(c, 3)) for p, cs in (("P1", ["C1", "C2", "C3"]), ("P2", ["C4"])) for i, c in enumerate(cs, 1)], "child_id string, parent_id string, sequence int, word_count int")
    ranked = spark.createDataFrame([("q", i, c) for i, c in enumerate(ranks, 1)], "qa_id string, rank int, child_id string")
    return context.context_bundles(ranked, kids, **config).first()


def test_contexts(spark):
    assert bundle(spark, ["C2", "C4", "C1"], {}, top_k=2, max_words=20).source_ids == ["C2", "C4"]
    near = bundle(spark, ["C2", "C4"], {}, top_k=2, max_words=12, radius=1)
    assert near.source_ids == ["C1", "C2", "C3", "C4"] and (near.anchor_count, near.neighbor_count) == (2, 2)
    assert bundle(spark, ["C1", "C2", "C4"], {}, top_k=2, max_per_parent=1).source_ids == ["C1", "C4"]
    skipped = bundle(spark, ["C1", "C2", "C4"], {"C1": 5, "C2": 9}, top_k=3, max_words=8)
    assert skipped.source_ids == ["C1", "C4"] and skipped.skipped == ["C2"]
    assert bundle(spark, ["C1"], {"C1": 50}, max_words=8).source_ids == ["C1"]
    with pytest.raises(ValueError):
        bundle(spark, ["C1"], {}, top_k=0)
    for bad in (["C1", "C1"], ["C9"]):
        with pytest.raises(Exception, match="child"):
            bundle(spark, bad, {})


def payload(**change):
    support = {"source_id": "C1", "quote": "the organisation shall report"}
    whole = {"answer_text": "a", "claims": [{"claim_id": "c1", "text": "t", "supports": [support]}], "abstain": False, "abstention_reason": None, "clarification_question": None}
    for k, v in change.items():
        (support if k in support else whole)[k] = v
    return json.dumps(whole)


def test_answers(spark):
    evidence_text = "4. “The organisation shall report, within 72 hours, any safety-related occurrence”"
    cases = {
        "valid": payload(),
        "unknown": payload(source_id="C9"),
        "typography": payload(quote="organisation shall report."),
        "elided": payload(quote="The organisation ... occurrence"),
        "reordered": payload(quote="shall the organisation report"),
        "abstains": payload(abstain=True, abstention_reason="outside_corpus", claims=[]),
        "bad reason": payload(abstain=True, abstention_reason="tired", claims=[]),
        "number": payload(answer_text=3),
        "no claims": payload(claims=[]),
        "list": "[1]",
        "null claims": payload(claims=None),
        "odd claims": payload(claims=[3, {"claim_id": "x", "text": "", "supports": []}, {"claim_id": "x", "text": "t", "supports": [4]}]),
    }
    said = spark.createDataFrame(list(cases.items()), "qa_id string, p string").select("qa_id", F.parse_json("p").alias("payload"))
    evidence = spark.createDataFrame([(q, "C1", evidence_text, "Article 1(1)", "DOC1", "P1") for q in cases], "qa_id string, source_id string, text string, canonical_citation string, document_id string, parent_id string")
    got = {r.qa_id: r for r in answers.verify(said, evidence).collect()}
    decisions = {k: r.decision for k, r in got.items()}
    assert {k for k, d in decisions.items() if d == "accept_structurally"} == {"valid", "typography"} and decisions["abstains"] == "abstain"
    assert got["typography"].quote_pass and not got["typography"].quote_pass_strict and got["valid"].supported_claim_ids == ["c1"]
    assert not got["elided"].quote_pass and got["elided"].elided_quotes == ["c1: elided quote from C1"] and not got["reordered"].quote_pass
    assert got["unknown"].quote_pass and got["unknown"].schema_errors == ["claims[0].supports[0].source_id is not allowed"]
    assert got["bad reason"].schema_errors == ["abstention_reason is required and must be allowed"]
    assert got["number"].schema_errors == ["answer_text must be a string"] and got["list"].schema_errors == ["payload must be an object"]
    assert got["null claims"].schema_errors == ["claims must be a list"] and got["no claims"].schema_errors == ["non-abstaining answers require at least one claim"]
    assert got["odd claims"].schema_errors == ["claims[0] must be an object", "claims[1].text must be a non-empty string", "claims[1].supports must be a non-empty list", "claims[2].claim_id must be unique", "claims[2].supports[0] must be an object"]
    found = {r.qa_id: r.canonical_citation for r in answers.resolve_citations(said, evidence).collect()}
    assert found["valid"] == "Article 1(1)" and "unknown" not in found
    assert answers.generation_summary(answers.verify(said, evidence)).first().n == len(cases)


CITED = {
    "see article 9(2)(c) there": [("376/2014", "ARTICLE", "9", ["2", "c"], True)],
    "Article 5 (1)(b)(ii)": [("376/2014", "ARTICLE", "5", ["1", "b", "ii"], True)],
    "Article 6(3); (5), (7)": [("376/2014", "ARTICLE", "6", [n], True) for n in "357"],
    "Art. 8(2)–(4)": [("376/2014", "ARTICLE", "8", [n], True) for n in "234"],
    "Article 8(2) to (40)": [("376/2014", "ARTICLE", "8", [n], True) for n in ("2", "40")],
    "Article 8(4)-(2)": [("376/2014", "ARTICLE", "8", [n], True) for n in "42"],
    "Article 10 paragraphs 1 to 3": [("376/2014", "ARTICLE", "10", [n], True) for n in "123"],
    "Article 10, paragraph 6, and more": [("376/2014", "ARTICLE", "10", ["6"], True)],
    "by GM 2.14, not GM2": [("376/2014", "GM", "2.14", [], False)],
    "recitals 7 and annex iii": [("376/2014", "ANNEX", "III", [], True), ("376/2014", "RECITALS", "7", [], True)],
    "the annexes and an annex": [("376/2014", "ANNEX", "", [], True)],
    "in 2021/2082, Article 1": [("2021/2082", "ARTICLE", "1", [], False)],
    "Article 1 " + "x" * 150 + " of 2021/2082": [("376/2014", "ARTICLE", "1", [], True)],
    "Article 3 of 2015/ 1018 and article 2 of 2020/2034": [("2015/1018", "ARTICLE", "3", [], False), ("2015/1018", "ARTICLE", "2", [], False)],
    "articles 2, 3 and 5(1)": [("376/2014", "ARTICLE", "2", [], True), ("376/2014", "ARTICLE", "3", [], True), ("376/2014", "ARTICLE", "5", ["1"], True)],
    "article 2 and 72 hours": [("376/2014", "ARTICLE", "2", [], True)],
    "article 2 and 3(1)": [("376/2014", "ARTICLE", "2", [], True), ("376/2014", "ARTICLE", "3", ["1"], True)],
    "particle 3, paragraph 3, 4(1)": [],
    "Article 12. Article 12, article 12(1)": [("376/2014", "ARTICLE", "12", [], True), ("376/2014", "ARTICLE", "12", ["1"], True)],
    "": [],
}


@pytest.mark.parametrize("text", CITED)
def test_citation_grammar(text):
    assert citations.parse(text) == CITED[text]


def test_citation_matches(spark):
    parents = spark.createDataFrame([(f"{p}_ART_2",) for p in citations.REGULATIONS.values()] + [("EU_376_2014_ART_4",), ("EU_376_2014_ART_9",), ("EU_376_2014_ART_13",), ("GM_EU_376_2014_SEC_3_1",), ("EU_2015_1018_ANNEX_V",), ("EU_376_2014_RECITALS",)], "parent_id string")
    pairs = [("a", "see Article 4(6)", "Article 4"), ("b", "x", "Paragraph 3"), ("c", "See Article 9(1).", "Article 9(1), Article 13(9)"), ("d", "Article 4", "Article 4"), ("e", "", "Article 77")]
    got = {r.id: (r.exact, r.parent) for r in citations.matches(spark.createDataFrame(pairs, "id string, prediction string, gold string"), parents).collect()}
    assert got == {"a": (False, True), "b": (None, None), "c": (False, False), "d": (True, True), "e": (False, None)}
    texts = spark.createDataFrame([("Article 2",), ("GM 3.1",), ("Annex V of 2015/1018",), ("recital 4",)], "text string")
    found = {r.text: len(r.parent_ids) for r in citations.candidates(citations.citations(texts), parents).collect()}
    assert found == {"Article 2": 4, "GM 3.1": 1, "Annex V of 2015/1018": 1, "recital 4": 1}


def test_mapping(spark):
    kids = spark.createDataFrame([("C1", "P1", 1, "pilots report accidents to the authority", "Article 4(1)"), ("C2", "P1", 2, "other words entirely", "Article 4(2)"), ("X", "P2", 1, "pilots report accidents", "Article 9")], "child_id string, parent_id string, sequence int, text string, canonical_citation string")
    qa = spark.createDataFrame([("low", "P1", "who reports accidents", "pilots report accidents to the authority.", "Article 4(1)"), ("high", "P1", "weather on mars", "unrelated", "Article 5"), ("none", "P9", "q", "a", "")], "qa_id string, parent_id string, question string, answer string, citation string")
    ranked = mapping.child_candidates(qa, kids)
    assert {r.qa_id: r.child_id for r in ranked.where("rank = 1").collect()}["low"] == "C1" and ranked.where("child_id = 'X'").count() == 0
    assert {r.qa_id: r.priority for r in mapping.review_priority(qa, ranked).collect()} == {"low": "low", "high": "high", "none": "blocking"}
    assert {r.qa_id: r.child_ids for r in mapping.proposed_evidence(qa, kids).collect()}["low"] == ["C1"]
    parents = spark.createDataFrame([("P1", "Alpha beta, gamma delta epsilon zeta"), ("P2", "short one"), ("P3", "entirely other content here")], "parent_id string, text string")
    chunks = spark.createDataFrame([("eq", "alpha BETA gamma delta epsilon zeta!"), ("in", "ta gamma delta eps"), ("out", "see short one here"), ("fuzzy", "content here other")], "chunk_id string, text string")
    got = {r.chunk_id: (r.status, r.method, r.parent_id) for r in mapping.lineage(chunks, parents).collect()}
    assert got == {"eq": ("auto_mapped", "normalized_equal", "P1"), "in": ("auto_mapped", "chunk_in_parent", "P1"), "out": ("auto_mapped", "parent_in_chunk", "P2"), "fuzzy": ("review_required", "fuzzy_review", "P3")}


def test_splits(spark):
    records = spark.createDataFrame([("Q1", "P1"), ("Q2", "P1"), ("Q3", "P2"), ("Q4", "P3"), ("Q5", "P4")], "qa_id string, parent_id string")
    got = splits.grouped_split(records)
    assert {r.split for r in got.collect()} == {"development", "test"} and splits.leaks(got).count() == 0
    assert sorted(got.collect()) == sorted(splits.grouped_split(records).collect())
    for bad in (records.where("parent_id = 'P1'"), records.where("false")):
        with pytest.raises(ValueError):
            splits.grouped_split(bad)
    with pytest.raises(Exception, match="no known split"):
        splits.inherited_split(records, got.select("qa_id", "split").where("qa_id <> 'Q1'")).collect()
    assert splits.stratified_sample(records, ["parent_id"], 1, "s").count() == 4
    assert splits.exemplars(records, records, 2, "s").where("q = exemplar").count() == 0


def review_row(**change):
    row = {"qa_id": "Q1", "reviewer_decision": "accept", **{c: "yes" for c in review.CHECKS}, "alternative_acceptable_child_ids": "", "alternative_evidence_sets_json": "", **{c: "" for c in review.CORRECTED}, "review_notes": "", "reviewer_name_or_role": "r", "review_date": "2026-08-01"}
    return row | change


def test_review(spark):
    kids = spark.createDataFrame([("C1", "P1"), ("C2", "P1"), ("C3", "P2"), ("C4", "P3")], "child_id string, parent_id string")
    asked = spark.createDataFrame([("Q1", "old", "a", "Article 1", "P1", ["C1"], "ai_rewritten_supported"), ("Q2", "q", "a", "Article 2", "P2", ["C3"], "ai_provisional_supported")], "qa_id string, question string, reference_answer string, acceptable_citation string, parent_id string, gold_child_ids array<string>, audit_decision string")

    def rows(*changes):
        return spark.createDataFrame([review_row(**c) for c in changes])

    def errors(*changes):
        return sorted(r.error for r in review.review_errors(rows(*changes), asked, kids, asked.select("qa_id").where("qa_id = 'Q1'")).collect())

    assert errors({}) == []
    assert errors({"reviewer_decision": "accept_with_alternative_evidence", "alternative_acceptable_child_ids": "C9"}) == ["unknown evidence child C9"]
    assert errors({"citation_correct": "maybe", "review_date": "1.2.2026"}) == ["accept requires all four checks to be yes", "citation_correct must be yes, no, or uncertain", "review_date must use YYYY-MM-DD"]
    assert errors({}, {}) == ["duplicate review row"] and "missing required review row" in errors({"qa_id": "Q2"})
    either = review.apply_decisions(asked, rows({"reviewer_decision": "accept_with_alternative_evidence", "alternative_acceptable_child_ids": "C2;C4"}), kids)
    own = {r.qa_id: r for r in either.collect()}
    assert own["Q1"].acceptable_evidence_sets == [["C1"], ["C2"], ["C4"]] and own["Q1"].acceptable_parent_ids == ["P1", "P3"]
    assert own["Q2"].review_status == "not_selected_for_independent_review" and own["Q2"].acceptable_evidence_sets == [["C3"]]
    fixed = {r.qa_id: r for r in review.apply_decisions(asked, rows({"reviewer_decision": "correct", "corrected_question": " new ", "corrected_gold_child_ids": "C2; C4"}), kids).collect()}["Q1"]
    assert fixed.question == "new" and fixed.gold_child_ids == ["C2", "C4"] and fixed.source_record_changed and fixed.audit_decision == "human_review_corrected"
    assert [r.qa_id for r in review.apply_decisions(asked, rows({"reviewer_decision": "exclude"}), kids).collect()] == ["Q2"]
    frozen = flows.freeze(asked, rows({}), kids)
    assert {r.split for r in frozen.collect()} == {"development", "test"}
    with pytest.raises(ValueError, match="frozen"):
        flows.freeze(asked, rows({"review_date": ""}), kids)


def test_panel(spark):
    header = ["Timestamp", "R1. Name"] + [f"QA_1 | C - Evaluation [{i}. check]" for i in range(1, 5)] + ["QA_1 | Q5 - Decision", "QA_1 | Q6 notes", "QA_2 | Q5 - Decision"]
    said = [("01/08/2026 10:00:00", "ann", *["Oui / Yes"] * 4, "Accepter / Accept", "fine", "Rejeter / Reject"), ("2026-08-02", "bob", *["Oui / Yes"] * 4, "Accepter / Accept", "", "Accepter / Accept"), ("", "", "Non / No", "", "", "", "Je passe cette fiche / I skip this record", "", "")]
    answers_ = review.form_answers(spark.createDataFrame(said, header))
    assert {r.rater for r in answers_.collect()} == {"ann", "bob", "anonymous"} and answers_.where("qa_id = 'QA_1' AND question = 'Q3'").count() == 2
    got = {r.qa_id: r for r in review.panel(spark.createDataFrame([("QA_1",), ("QA_2",), ("QA_3",)], "qa_id string"), review.votes(answers_)).collect()}
    assert (got["QA_1"].auto_decision, got["QA_1"].n_reviewers) == ("accept", 2)
    assert got["QA_2"].action_needed == "the reviewers are divided" and got["QA_3"].action_needed == "only 0 reviewer(s), need 2"


def test_baselines(spark):
    calls = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "key string, request string")
    cached = spark.createDataFrame([("a", "old")], "key string, response string")
    got = baselines.through_cache(calls, cached, lambda texts: [t.upper() for t in texts]).collect()
    assert sorted(map(tuple, got)) == [("a", "old", True), ("b", "Y", False), ("b", "Y", False)]
    strict = baselines.strict_schema({"$schema": "s", "type": "object", "properties": {"a": {"type": "string", "minLength": 1}, "oneOf": {"oneOf": [{"type": "string", "enum": ["x"]}, {"type": "null"}]}}})
    assert strict == {"type": "object", "properties": {"a": {"type": "string"}, "oneOf": {"type": ["string", "null"], "enum": ["x", None]}}, "required": ["a", "oneOf"], "additionalProperties": False}
    shots = spark.createDataFrame([("q", 1, "x", "y")], "q string, rank int, question string, answer string")
    prompt = baselines.few_shot_prompt(shots, spark.createDataFrame([("q", "why"), ("r", "how")], "q string, question string"))
    assert {r.q: r.prompt for r in prompt.collect()} == {"q": "Question: x\nAnswer: y\n\nQuestion: why\nAnswer:", "r": "Question: how\nAnswer:"}
    assert one(spark, baselines.user_message("Q {question} S {sources}", lit("a"), lit("b"))) == "Q a S b"


def test_guards_and_files(spark, tmp_path):
    with pytest.raises(ValueError, match="differ"):
        relational.require_empty(relational.key_differences(spark.range(2).toDF("k"), spark.range(1).toDF("k"), "k"), "keys differ")
    (tmp_path / "p.md").write_text("# t\n## System\nbe terse\n\n## User template\nQ {question}\nS {sources}\n")
    assert files.read_prompt(spark, str(tmp_path / "p.md")) == {"System": "be terse", "User template": "Q {question}\nS {sources}"}
    with pytest.raises(ValueError):
        files.read_prompt(spark, str(tmp_path / "p.md"), ("Other",))
    (tmp_path / "c.csv").write_bytes('﻿a,b\n1,"x ""y""\nz"\n,\n'.encode())
    assert [tuple(r) for r in files.read_csv_strings(spark, str(tmp_path / "c.csv"), ["a", "b"]).collect()] == [("1", 'x "y"\nz'), ("", "")]
    for name, text in (("one", '{"status": "ok"}'), ("two", "{broken")):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "manifest.json").write_text(text)
    assert [tuple(r) for r in files.read_manifests(spark, str(tmp_path / "runs/*/manifest.json"), "status string").collect()] == [("ok", "one")]
    assert files.file_digests(spark, str(tmp_path / "p.md")).count() == 1


def test_commands(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"qa_id": "q", "question": "alpha"}\n')
    (tmp_path / "c.jsonl").write_text('{"id": "a", "text": "alpha"}\n\n{"id": "b", "text": "beta"}\n')
    args = ["bm25", str(tmp_path / "q.jsonl"), str(tmp_path / "c.jsonl"), str(tmp_path / "out.jsonl"), "--limit", "2"]
    assert commands.main(args, spark) == 0
    assert [r.id for r in spark.read.json(str(tmp_path / "out.jsonl")).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="exists"):
        commands.main(args, spark)


def test_similar_brute_force(spark):
    """The most alike parents, whether or not a chunk's rarer words lead to enough of them."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60) for _ in range(60 // (k + 1))]
    parents = {i: [rng.choice(words) for _ in range(rng.randrange(1, 90))] for i in range(50)}
    chunks = {f"c{i}": [rng.choice(words) for _ in range(rng.randrange(1, 25))] for i in range(30)} | {"none": ["zzz"], "rare": ["w59", "w58"], "common": ["w0", "w1", "w0"]}

    def score(a, b):
        x, y = collections.Counter(a), collections.Counter(b)
        cosine = sum(x[t] * y[t] for t in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return round(0.3 * cosine + 0.7 * sum(min(x[t], y[t]) for t in x) / len(a), 6)

    frame = lambda d, key: spark.createDataFrame([(k, " ".join(v)) for k, v in d.items()], f"{key} {'string' if key == 'chunk_id' else 'long'}, text string")
    wanted = spark.createDataFrame([("c3", 7)], "chunk_id string, parent_id long")
    got = collections.defaultdict(dict)
    for r in mapping.similar(frame(chunks, "chunk_id"), frame(parents, "parent_id"), wanted, 5).collect():
        got[r.chunk_id][r.parent_id] = round(r.score, 6)
    for c, words_ in chunks.items():
        want = sorted((score(words_, p) for p in parents.values()), reverse=True)
        assert sorted(got[c].values(), reverse=True)[:5] == pytest.approx([x for x in want[:5] if x > 0], abs=2e-6)
        assert all(abs(got[c][p] - score(words_, parents[p])) < 2e-6 for p in got[c])
    assert set(parents[7]).isdisjoint(chunks["c3"]) or 7 in got["c3"]


def test_vector_cache(spark, tmp_path):
    asked = []

    def embed(texts):
        asked.append(len(texts))
        return [(i, [float(len(texts[i])), 1.0]) for i in reversed(range(len(texts)))]

    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None), (4, "bb")], "id long, text string")
    first, matched = providers.cached_vectors(rows, str(tmp_path / "v"), "m", embed)
    assert not matched and {r.id: r.embedding[0] for r in first.collect()} == {1: 1.0, 2: 2.0, 3: 0.0, 4: 2.0}
    again, matched = providers.cached_vectors(rows, str(tmp_path / "v"), "m", None)
    assert matched and again.count() == 4
    more = spark.createDataFrame([(1, "a"), (5, "ccc")], "id long, text string")
    got = {r.id: (r.embedding[0], r.cached) for r in providers.cached_vectors(more, str(tmp_path / "v"), "m", embed)[0].collect()}
    assert got == {1: (1.0, True), 5: (3.0, False)}
    other = providers.cached_vectors(more, str(tmp_path / "v"), "n", embed)[0]
    assert {r.cached for r in other.collect()} == {False}
    with pytest.raises(Exception, match="answer every text once"):
        providers.embedded(rows.coalesce(1), lambda texts: [(0, [1.0])]).collect()
    with pytest.raises(Exception, match="score every pair"):
        providers.scored_pairs(spark.createDataFrame([("a", "b")], "question string, text string"), lambda pairs: []).collect()


def test_ladder_resumes_and_reranks(spark, tmp_path):
    questions = spark.createDataFrame([("q", "pilots report accidents")], "qa_id string, question string")
    kids = spark.createDataFrame([("a", "pilots report accidents", "P1", 1, 3), ("b", "pilots fly", "P1", 2, 2), ("c", "weather", "P2", 1, 1)], "id string, text string, parent_id string, sequence int, word_count int")
    vectors = providers.embedded(kids.select("id", "text"), providers.hashed_vectors()).drop("text")
    asked = providers.embedded(questions, providers.hashed_vectors(), "question").drop("question")
    found = flows.ladder(questions, kids, asked, vectors, 3, scores=providers.lexical_scores, folder=str(tmp_path / "l"), top_k=2)
    assert {n: [r.id for r in found[n].orderBy("rank").collect()][0] for n in ("bm25", "dense", "hybrid", "reranked")} == dict.fromkeys(("bm25", "dense", "hybrid", "reranked"), "a")
    assert found["contexts"].first().source_ids == ["a", "b"]

    def broken(pairs):
        raise AssertionError("a finished stage must not run again")

    assert flows.ladder(questions, kids, asked, vectors, 3, scores=broken, folder=str(tmp_path / "l"), top_k=2)["reranked"].count() == 3


def test_commands_of_flows(spark, tmp_path):
    def put(name, *rows):
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
        return str(tmp_path / name)

    questions = put("q.jsonl", {"qa_id": "q", "question": "who reports accidents"}, {"qa_id": "r", "question": "zzz"})
    kids = put("c.jsonl", {"id": "a", "text": "Pilots report accidents."}, {"id": "b", "text": "Weather."})
    for name, source in (("kv", kids), ("qv", put("qt.jsonl", {"id": "q", "text": "who reports accidents"}, {"id": "r", "text": "zzz"}))):
        assert commands.main(["embed", source, str(tmp_path / f"{name}.jsonl")], spark) == 0
    asked = put("qv2.jsonl", *({"qa_id": r.id, "embedding": r.embedding} for r in spark.read.json(str(tmp_path / "qv.jsonl")).collect()))
    assert commands.main(["ladder", questions, kids, asked, str(tmp_path / "kv.jsonl"), str(tmp_path / "ladder")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "ladder" / "reranked")).where("qa_id = 'q' AND rank = 1").first().id == "a"
    sources = put("s.jsonl", *({"qa_id": q, "position": 1, "source_id": "S1", "text": "Pilots report accidents.", "canonical_citation": "Article 4", "document_id": "D", "parent_id": "P"} for q in "qr"))
    assert commands.main(["generate", questions, sources, str(tmp_path / "made")], spark) == 0
    reports = {r.qa_id: r.decision for r in spark.read.json(str(tmp_path / "made" / "reports.jsonl")).collect()}
    assert reports == {"q": "accept_structurally", "r": "abstain"}
    assert [r.qa_id for r in spark.read.json(str(tmp_path / "made" / "citations.jsonl")).collect()] == ["q"]
    assert commands.main(["environment", questions, str(tmp_path / "env.jsonl")], spark) == 0
    assert {"python", "spark"} <= {r.name for r in spark.read.json(str(tmp_path / "env.jsonl")).collect()}


def test_exemplars_are_each_questions_own(spark):
    rows = spark.range(30).select(F.col("id").alias("qa_id"))
    got = {}
    for r in splits.exemplars(rows, rows, 3, "s").collect():
        got.setdefault(r.q, []).append(r.exemplar)
    assert len(got) == 30 and all(len(set(x)) == 3 and q not in x for q, x in got.items()) and len({tuple(sorted(x)) for x in got.values()}) > 10
    two = spark.range(2).select(F.col("id").alias("qa_id"))
    assert sorted((r.q, r.exemplar) for r in splits.exemplars(two, two, 5, "s").collect()) == [(0, 1), (1, 0)]


def test_calibration(spark):
    rows = spark.createDataFrame([(3, 0.2, 1, 1, 1, 1, 0, 0), (0, 2.0, 3, 2, 1, 1, 0, 1), (2, 1.2, 2, 2, 0, 0, 0, 1)], "top1_rank_shift int, rerank_margin double, distinct_sources_cited int, claim_count int, quote_pass int, quote_pass_strict int, model_abstained int, evidence_correct int")
    got = {r.rule: r for r in calibration.rule_statistics(rows).collect()}
    assert len(got) == 13 and got["reranker moved top-1 by >= 2 ranks"].precision == 0.5 and got["model abstained"].precision is None
    both = calibration.failure_overlap(rows, "evidence_correct = 0", "quote_pass = 0").first()
    assert (both.a, both.b, both.both, both.either) == (1, 1, 0, 2)
    assert calibration.sample_sizes(rows, "evidence_correct = 0").count() == 4


def test_vote_stream(spark, tmp_path):
    """Repeated votes count once, a changed one moves its count, one out of order changes nothing, and one beyond the watermark is dropped."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STORE)
    (tmp_path / "in").mkdir()
    parts = [
        [("a", "Accepter / Accept", "01T10"), ("a", "Accepter / Accept", "01T10"), ("b", "Rejeter / Reject", "01T10"), ("c", "I skip this record", "01T10"), ("d", "Accepter / Accept", "01T12")],
        [("a", "Rejeter / Reject", "01T11"), ("d", "Rejeter / Reject", "01T09")],
        [("e", "Accepter / Accept", "09T10")],
        [("f", "Accepter / Accept", "02T10"), ("g", "Accepter / Accept", "09T09")],
    ]
    try:
        for i, votes in enumerate(parts):
            (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"qa_id": "Q", "rater": r, "decision": d, "at": f"2026-08-{t}:00:00"}) for r, d, t in votes))
            changes = stream.decision_changes(stream.read_votes(spark, str(tmp_path / "in"), 1), late_hours=24)
            out = changes.writeStream.foreachBatch(lambda rows, _: rows.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "at")).outputMode("update").trigger(availableNow=True).start()
            out.awaitTermination(120)
            got = {r.decision: r.n for r in stream.decision_counts(spark.read.parquet(str(tmp_path / "out"))).collect()}
            assert got == [{"accept": 2, "exclude": 1}, {"accept": 1, "exclude": 2}, {"accept": 2, "exclude": 2}, {"accept": 3, "exclude": 2}][i]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_snapshots_survive_a_crash(spark, tmp_path, monkeypatch):
    at, embed = str(tmp_path / "v"), lambda texts: [(i, [float(len(t))]) for i, t in enumerate(texts)]
    rows = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, text string")
    providers.cached_vectors(rows, at, "m", embed)
    publish = providers._publish

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(providers, "_publish", crash)
    more = rows.union(spark.createDataFrame([(3, "ccc")], rows.schema))
    with pytest.raises(RuntimeError, match="lost"):
        providers.cached_vectors(more, at, "m", embed)
    old, matched = providers.cached_vectors(rows, at, "m", None)
    assert matched and {r.id: r.embedding for r in old.collect()} == {1: [1.0], 2: [2.0]}
    monkeypatch.setattr(providers, "_publish", publish)
    for n in range(3):  # older snapshots go
        providers.cached_vectors(rows.union(spark.createDataFrame([(9 + n, "x" * n)], rows.schema)), at, "m", embed)
    for at_ in ("published", "snapshots"):
        assert len([x for x in os.listdir(tmp_path / "v" / at_) if not x.startswith(".")]) <= providers.SNAPSHOTS_KEPT + 1  # the crashed one was never published
    got, matched = providers.cached_vectors(more, at, "m", embed)
    assert not matched and {r.id: r.cached for r in got.collect()} == {1: True, 2: True, 3: False}


def test_lost_run_asks_only_for_the_rest(spark, tmp_path):
    requests = spark.createDataFrame([(f"k{i}", f"r{i}") for i in range(40)] + [("k0", "r0")], "key string, request string").coalesce(1)
    log, broken = tmp_path / "asked", tmp_path / "broken"
    broken.touch()

    def provider(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if os.path.exists(broken) and len(open(log).readlines()) > 20:
            raise RuntimeError("lost")
        return [t.upper() for t in texts]

    with pytest.raises(Exception, match="lost"):
        baselines.through_folder(requests, str(tmp_path / "answers"), provider, commit=5)
    have = {r.key for r in spark.read.parquet(str(tmp_path / "answers")).collect()}
    assert 0 < len(have) < 40
    broken.unlink()
    log.unlink()
    got = baselines.through_folder(requests, str(tmp_path / "answers"), provider, commit=5).collect()
    assert sorted(log.read_text().split()) == sorted(f"r{i}" for i in range(40) if f"k{i}" not in have)
    assert len(got) == 41 and all(r.response == "R" + r.key[1:] and r.cached == (r.key in have) for r in got)


def test_manifest_of_a_sink(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = spark.range(10).select("id", F.when(F.col("id") > 2, F.concat(lit("é,_"), F.col("id"))).alias("text")).repartition(3)
    manifested.write(rows, at)
    assert manifested.read(spark, at, "id long, text string").count() == 10
    assert {tuple(r) for r in manifested.read(spark, at, "id long, text string").collect()} == {tuple(r) for r in rows.collect()}
    with pytest.raises(Exception, match="written already"):
        manifested.write(rows, at)
    manifested.write(rows.limit(1), at, overwrite=True)
    said = json.loads((tmp_path / "t" / "manifest.json").read_text())
    assert said["rows"] == 1 and len(said["files"]) == 1 and sorted(os.listdir(at)) == ["manifest.json", said["files"][0]["name"]]
    (tmp_path / "t" / said["files"][0]["name"]).write_text("{}")
    with pytest.raises(ValueError, match="not what its manifest says"):
        manifested.read(spark, at, "id long, text string")
    failing = rows.withColumn("id", F.when(F.col("id") == 7, F.raise_error(lit("boom")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="boom"):
        manifested.write(failing, str(tmp_path / "u"))
    assert not os.path.exists(tmp_path / "u" / "manifest.json") and not os.path.exists(tmp_path / "u" / "_parts")
    manifested.write(rows.where("id < 0"), str(tmp_path / "e"))
    assert manifested.read(spark, str(tmp_path / "e"), "id long, text string").count() == 0
    manifested.write(rows.orderBy("id").limit(4), str(tmp_path / "x"), "tex")
    (name,) = [x for x in os.listdir(tmp_path / "x") if x.startswith("part")]
    assert (tmp_path / "x" / name).read_text().splitlines()[5:8] == ["1 & -- \\\\", "2 & -- \\\\", "3 & é,\\_3 \\\\"]
    manifested.write(rows.orderBy("id").coalesce(1), str(tmp_path / "c"), "csv")
    assert (tmp_path / "c" / "part-00000.csv").read_text().splitlines()[:2] == ["id,text", "0,"]


def test_numbers_and_splits_of_many_groups(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert {r.k: r.number for r in relational.numbered(rows, [F.desc("k")]).collect()} == {k: 1000 - k for k in range(1000)}
    rng = random.Random(5)
    for _ in range(3):
        sizes = {f"g{i}": rng.choice([1, 1, 1, 2, 3, 9]) for i in range(rng.choice([2, 7, 40]))}
        records = spark.createDataFrame([(f"{g}-{i}", g) for g, n in sizes.items() for i in range(n)], "qa_id string, parent_id string")
        total = sum(sizes.values())
        target, dev, test, want = round(total * 0.4), 0, 0, {}
        order = sorted(sizes, key=lambda g: (-sizes[g], hashlib.sha256(f"lodestone-v1:{g}".encode()).hexdigest()))
        for i, g in enumerate(order):
            take = test > 0 if i == len(order) - 1 else abs(target - dev - sizes[g]) <= abs(target - dev)
            dev, test = dev + take * sizes[g], test + (not take) * sizes[g]
            want[g] = "development" if take else "test"
        assert {r.parent_id: r.split for r in splits.grouped_split(records).collect()} == want


def test_cells_brute_force(spark, monkeypatch):
    """Several blocks of questions and documents: scores, ties and bounds of BM25 against a plain count, and fewer entries read than there are."""
    monkeypatch.setattr(cells, "CELL_QUESTIONS", 7)
    monkeypatch.setattr(cells, "CELL_ENTRIES", 500)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(80) for _ in range(160 // (k + 1))]
    docs = {i: [rng.choice(words) for _ in range(rng.randrange(0, 60))] for i in range(300)}
    docs |= {300 + i: docs[i % 5] for i in range(20)}  # ties
    asked = {f"q{i}": [rng.choice(words) for _ in range(rng.randrange(1, 12))] for i in range(20)} | {"rare": ["w79", "w70", "w0"], "none": ["zzz"]}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    tf = {i: collections.Counter(d) for i, d in docs.items()}
    df = collections.Counter(t for c in tf.values() for t in c)

    def score(q, i):
        return sum(f * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[i][t] * 2.5 / (tf[i][t] + 1.5 * (0.25 + 0.75 * len(docs[i]) / mean)) for t, f in collections.Counter(q).items() if tf[i][t])

    frame = lambda d, key, text: spark.createDataFrame([(k, " ".join(v)) for k, v in d.items()], f"{key} {'string' if text == 'question' else 'long'}, {text} string")
    whole = retrieval.index(frame(docs, "id", "text"))
    got = collections.defaultdict(list)
    for r in retrieval.bm25(frame(asked, "qa_id", "question"), whole, 5).orderBy("qa_id", "rank").collect():
        got[r.qa_id].append((r.id, round(r.score, 6)))
    for q, terms in asked.items():
        want = sorted(((round(score(terms, i), 8), -i) for i in docs), reverse=True)[:5]
        assert got[q] == [(-i, pytest.approx(s, abs=2e-6)) for s, i in want]
    counted = spark.createDataFrame([(q, t, f) for q, terms in asked.items() for t, f in collections.Counter(terms).items()], "qa_id string, term string, qf long")
    found = retrieval.bm25_cells(counted, whole, 5, 1.5, 0.75)
    read, left = found.agg(F.sum("entries"), F.count(lit(1))).first()
    every = sum(df[t] for terms in asked.values() for t in set(terms))
    print(f"{read} of {every} entries read, {left} rows left the cells, for {len(asked)} questions")
    assert read < 0.8 * every
    vectors = spark.createDataFrame([(i, [float(rng.randrange(-3, 4)) for _ in range(4)] if i % 9 else [1.0, 0.0, 0.0, 0.0]) for i in range(90)], "id long, embedding array<double>").where("aggregate(embedding, 0D, (a, x) -> a + x * x) > 0")
    rows = {r.id: r.embedding for r in vectors.collect()}
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows.items()}
    near = collections.defaultdict(list)
    for r in retrieval.cosine_top_k(vectors, vectors, 3, "id", "id", exclude_self=True).orderBy("q", "rank").collect():
        near[r.q].append(r.id)
    for q, v in unit.items():
        assert near[q] == [i for _, i in sorted((-round(sum(a * b for a, b in zip(v, w)), 8), i) for i, w in unit.items() if i != q)[:3]]


def test_reruns_of_baselines(spark, tmp_path):
    """Examples, retrieval, prompts, kept answers and rescoring in one flow; the second run asks nothing."""

    def put(name, *rows):
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
        return str(tmp_path / name)

    asked = [("q1", "Who reports accidents?"), ("q2", "What is weather?")]
    questions = put("q.jsonl", *({"qa_id": i, "question": q} for i, q in asked))
    chunks = put("c.jsonl", {"id": "a", "citation": "Article 4", "text": "Pilots report accidents. Others do not."}, {"id": "b", "citation": "Article 5", "text": "Weather is what falls."})
    examples = put("e.jsonl", *({"qa_id": i, "question": q, "answer": f"Answer to {q}"} for i, q in [*asked, ("q3", "Who reports weather?")]))
    assert commands.main(["rerun", questions, chunks, str(tmp_path / "rag.jsonl"), "--top-k", "1"], spark) == 0
    rag = {r.qa_id: r for r in spark.read.json(str(tmp_path / "rag.jsonl")).collect()}
    assert rag["q1"].prediction == "Pilots report accidents." and rag["q1"].retrieved_chunks == ["a"] and rag["q2"].retrieved_chunks == ["b"]
    assert commands.main(["rerun", questions, examples, str(tmp_path / "shots.jsonl"), "--system", "fewshot", "--top-k", "2"], spark) == 0
    shots = {r.qa_id: r.prediction for r in spark.read.json(str(tmp_path / "shots.jsonl")).collect()}
    assert shots["q1"] == "Answer to Who reports weather?" and shots["q2"] in ("Answer to Who reports weather?", "Answer to Who reports accidents?")
    local = flows.rerun(spark.read.json(questions), spark.read.json(questions), "local", 0, lambda texts: [t.upper() for t in texts], str(tmp_path / "local"))
    assert {r.qa_id: r.prediction for r in local.collect()}["q1"] == "QUESTION: WHO REPORTS ACCIDENTS?\nANSWER:"
    again = flows.rerun(spark.read.json(questions), spark.read.json(questions), "local", 0, None, str(tmp_path / "local")).collect()
    assert len(again) == 2 and all(r.cached for r in again)
    bench = spark.createDataFrame([(i, "test", q, "Pilots report accidents.", "Article 4", ["P"]) for i, q in asked], "qa_id string, split string, question string, reference_answer string, acceptable_citation string, acceptable_parent_ids array<string>")
    parents = spark.createDataFrame([("EU_376_2014_ART_4",)], "parent_id string")
    scored = {r.qa_id: r for r in baselines.rescore(spark.read.json(str(tmp_path / "rag.jsonl")), bench, parents, spark.createDataFrame([("a", "P")], "chunk_id string, parent_id string")).collect()}
    assert scored["q1"].rouge_l == 1.0 and (scored["q1"].retrieval_parent_hit, scored["q2"].retrieval_parent_hit) == (1, 0)
    table = put("rules.jsonl", {"rule": "a_b", "rate": 0.5})
    assert commands.main(["report", table, str(tmp_path / "report")], spark) == 0
    assert "0.5 & a\\_b" in (tmp_path / "report" / "rules" / "part-00000.tex").read_text()
    with pytest.raises(ValueError):
        flows.rerun(spark.read.json(questions), spark.read.json(questions), "odd", 1, None, str(tmp_path / "x"))


def test_cached_scores(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a b", "b c"), (2, "a b", "b c"), (3, None, "x"), (4, "q", "q")], "id long, question string, text string")
    got = {r.id: (r.score, r.cached) for r in providers.cached_scores(pairs, str(tmp_path / "s"), "m", providers.lexical_scores, commit=1).collect()}
    assert got == {1: (1 / 3, False), 2: (1 / 3, False), 3: (0.0, False), 4: (1.0, False)}
    again = {r.id: (r.score, r.cached) for r in providers.cached_scores(pairs.where("id > 1"), str(tmp_path / "s"), "m", None).collect()}
    assert again == {2: (1 / 3, True), 3: (0.0, True), 4: (1.0, True)}


def test_scratch_tables_go(spark):
    before = shared.materialized(spark.range(3), "before")
    with shared.scratch(spark):
        outer = shared.materialized(spark.range(4), "outer")
        with pytest.raises(RuntimeError), shared.scratch(spark):
            inner = shared.materialized(outer, "inner")
            assert inner.count() == 4
            raise RuntimeError
        assert outer.count() == 4 and not os.path.exists(inner.inputFiles()[0].removeprefix("file://"))
        at = os.path.dirname(outer.inputFiles()[0].removeprefix("file://"))
        assert os.path.isdir(at)
    assert not os.path.exists(at) and before.count() == 3
