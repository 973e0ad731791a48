"""Queries for ranking, evaluation, mapping, contexts, answers, review and calibration."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators import answers, baselines, calibration, citations, context, corpus, mapping, providers, retrieval, review
from lodestone.plans import flows
from lodestone.plans.registry import query
from lodestone.plans.relation_queries import split_sql
from lodestone.plans.views import CITED, LINES_CTE, TOK, children, lines, questions
from lodestone.sources import wordml
from lodestone.sources.shared import materialized, shared_dir

_BM25 = f"""d AS (SELECT doc_id, {TOK.format('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS f FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT item_id AS qa_id, doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (1 - {{b}} + {{b}} * len / mean)) * qf), 8) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, id) AS rank FROM sc)"""
_NORMAL = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ')"
_GOLD = f"gold AS (SELECT i.item_id AS qa_id, list(d.doc_id) AS ids FROM (SELECT item_id, {_NORMAL.format('text')} AS t FROM benchmark) i JOIN (SELECT doc_id, {_NORMAL.format('text')} AS t FROM documents) d ON contains(d.t, i.t) GROUP BY 1)"


def _bm25(t, b=0.75, limit=20, index=None):
    return retrieval.bm25(questions(t), index or t.documents.select(F.col("doc_id").alias("id"), "text"), limit, b=b)


def _gold(t):
    """(qa_id, doc_id): documents that hold a benchmark item."""
    chunks = t.benchmark.select(F.col("item_id").alias("chunk_id"), "text")
    found = mapping.containment(chunks, t.documents.select(F.col("doc_id").alias("parent_id"), "text"))
    return found.where("within").select(F.col("chunk_id").alias("qa_id"), F.col("parent_id").alias("doc_id"))


@query(f"WITH {_BM25.format(b=0.75)} SELECT qa_id, id, round(score, 6) AS score, rank FROM rk WHERE rank <= 20")
def r01_bm25_top20(t):
    return _bm25(t).select("qa_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT q, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS q, d.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 8) AS score FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 10")
def r02_r03_dense_top10(t):
    out = retrieval.cosine_top_k(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, 10, "vec_id", "vec_id", exclude_self=True)
    return out.select("q", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH a AS (WITH {_BM25.format(b=0.75)} SELECT qa_id, id, rank FROM rk WHERE rank <= 20), b AS (WITH {_BM25.format(b=0.0)} SELECT qa_id, id, rank FROM rk WHERE rank <= 20), f AS (SELECT qa_id, id, round(sum(1.0 / (60 + rank)), 10) AS score, min(rank) AS best_rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) SELECT qa_id, id, score, best_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, best_rank, id) AS rank FROM f) WHERE rank <= 20")
def r04_rrf(t):
    index = retrieval.index(t.documents, "doc_id")
    both = [_bm25(t, b, index=index).select(F.lit(f"b{b}").alias("ranker"), F.lit(1.0).alias("weight"), "qa_id", "id", "rank") for b in (0.75, 0.0)]
    out = retrieval.reciprocal_rank_fusion(both[0].unionByName(both[1]), 60, 20)
    return out.withColumns({"rank": F.col("rank").cast("long"), "best_rank": F.col("best_rank").cast("long")})


@query("SELECT o_custkey AS qa_id, o_orderkey AS id, original_rank, score, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, original_rank, o_orderkey) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS original_rank, CAST(ascii(o_orderstatus) AS DOUBLE) AS score FROM orders)")
def r05_rerank(t):
    own = retrieval.top_k(t.orders.select(F.col("o_custkey").alias("qa_id"), F.col("o_orderkey").alias("id"), F.ascii("o_orderstatus").cast("double").alias("score")), ["qa_id"], [F.asc("id")], None, "original_rank")
    return retrieval.rerank(own).withColumns({"rank": F.col("rank").cast("long"), "original_rank": F.col("original_rank").cast("long")})


_IDEAL = "list_sum([1 / log2(r + 1) for r in generate_series(1, least(len(ids), k))])"


@query(f"""WITH {_BM25.format(b=0.75)}, {_GOLD}, m AS (SELECT g.qa_id, CASE WHEN g.qa_id % 2 = 0 THEN 'development' ELSE 'test' END AS split, k, count(*) FILTER (h) AS hits, min(rank) FILTER (h) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (h), 0) / {_IDEAL} AS ndcg, count(*) FILTER (h) / len(ids) AS recall
FROM (SELECT g.qa_id, ids, k, rank, list_contains(ids, rk.id) AS h FROM gold g, (VALUES (1), (3), (5), (10), (20)) v(k), rk WHERE rk.qa_id = g.qa_id AND rk.rank <= k) g GROUP BY g.qa_id, ids, k)
SELECT split, k, count(*) AS n, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS parent_recall, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS any_gold_recall, round(avg(recall), 6) AS evidence_recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY GROUPING SETS ((split, k), (k))""")
def r11_metrics(t):
    """At every cutoff of the reference. A question that no document holds has no evidence to be found, and no metrics."""
    gold = materialized(_gold(t), "gold").groupBy("qa_id").agg(F.collect_list("doc_id").alias("ids"))
    qa = gold.select("qa_id", F.when(F.col("qa_id") % 2 == 0, "development").otherwise("test").alias("split"), F.array("ids").alias("evidence_sets"), F.col("ids").alias("parent_ids"))
    return retrieval.evaluate(qa, _bm25(t), t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("parent_id")), [1, 3, 5, 10, 20])


@query(f"WITH {_BM25.format(b=0.75)}, {_GOLD} SELECT qa_id, bool_or(list_contains(ids, id)) AS hit FROM gold JOIN rk USING (qa_id) WHERE rank <= 3 GROUP BY qa_id")
def r12_retrieval_hit(t):
    ranked = _bm25(t).where("rank <= 3").groupBy("qa_id").agg(F.collect_list("id").alias("found"))
    return _gold(t).groupBy("qa_id").agg(F.collect_list("doc_id").alias("ids")).join(ranked, "qa_id").select("qa_id", F.arrays_overlap("ids", "found").alias("hit"))


@query(f"""WITH c AS (SELECT item_id, {_NORMAL.format('text')} AS t FROM benchmark), p AS (SELECT doc_id, {_NORMAL.format('text')} AS t FROM documents), x AS (SELECT item_id, count(*) FILTER (c.t = p.t) AS n1, count(*) FILTER (contains(p.t, c.t)) AS n2, count(*) FILTER (contains(c.t, p.t) AND p.t <> '') AS n3, min(doc_id) FILTER (c.t = p.t) AS p1, min(doc_id) FILTER (contains(p.t, c.t)) AS p2, min(doc_id) FILTER (contains(c.t, p.t) AND p.t <> '') AS p3 FROM c, p WHERE c.t <> '' GROUP BY item_id),
ct AS (SELECT item_id, term, count(*) AS f FROM (SELECT item_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL), pt AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(least(ct.f, pt.f)) AS both_, CAST(sum(ct.f * pt.f) AS DOUBLE) AS dot FROM ct JOIN pt USING (term) GROUP BY ALL),
a AS (SELECT item_id, doc_id, dot / (sqrt(cn) * sqrt(pn)) AS cosine, both_ / cl AS coverage FROM s JOIN (SELECT item_id, CAST(sum(f * f) AS DOUBLE) AS cn, sum(f) AS cl FROM ct GROUP BY 1) USING (item_id) JOIN (SELECT doc_id, CAST(sum(f * f) AS DOUBLE) AS pn FROM pt GROUP BY 1) USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(0.3 * cosine + 0.7 * coverage, 8) DESC, round(cosine, 10) DESC, round(coverage, 10) DESC, doc_id DESC) AS k, round(0.3 * cosine + 0.7 * coverage, 8) AS score FROM a)
, y AS (SELECT x.item_id, CASE WHEN n1 = 1 THEN 'normalized_equal' WHEN n2 = 1 THEN 'chunk_in_parent' WHEN n3 = 1 THEN 'parent_in_chunk' ELSE 'fuzzy_review' END AS method, CASE WHEN n1 = 1 THEN p1 WHEN n2 = 1 THEN p2 WHEN n3 = 1 THEN p3 ELSE doc_id END AS parent_id FROM x LEFT JOIN r ON r.item_id = x.item_id AND k = 1),
o AS (SELECT item_id, score, cosine, coverage, k, r.doc_id, y.parent_id, method FROM y LEFT JOIN r USING (item_id))
SELECT item_id AS chunk_id, CASE any_value(method) WHEN 'fuzzy_review' THEN 'review_required' ELSE 'auto_mapped' END AS status, any_value(method) AS method, any_value(parent_id) AS parent_id, round(coalesce(max(score) FILTER (doc_id = parent_id), 0), 6) AS match_score, round(coalesce(max(cosine) FILTER (doc_id = parent_id), 0), 6) AS cosine, round(coalesce(max(coverage) FILTER (doc_id = parent_id), 0), 6) AS coverage, round(coalesce(max(score) FILTER (doc_id = parent_id), 0) - coalesce(max(score) FILTER (doc_id <> parent_id AND k <= 5), 0), 6) AS margin, string_agg(CAST(doc_id AS STRING), ';' ORDER BY k) FILTER (k <= 5) AS candidates FROM o GROUP BY item_id""")
def r08_lineage_map(t):
    return mapping.lineage(t.benchmark.select(F.col("item_id").alias("chunk_id"), "text"), t.documents.select(F.col("doc_id").alias("parent_id"), "text"))


@query(f"WITH c AS (SELECT item_id, {_NORMAL.format('text')} AS t FROM benchmark), p AS (SELECT doc_id, {_NORMAL.format('text')} AS t FROM documents) SELECT item_id AS chunk_id, doc_id AS parent_id, c.t = p.t AS equal, contains(p.t, c.t) AS within, contains(c.t, p.t) AS contains FROM c, p WHERE c.t <> '' AND p.t <> '' AND (contains(p.t, c.t) OR contains(c.t, p.t))")
def j10_containment(t):
    return mapping.containment(t.benchmark.select(F.col("item_id").alias("chunk_id"), "text"), t.documents.select(F.col("doc_id").alias("parent_id"), "text"))


_CT = "[x for x in regexp_extract_all(lower({0}), '[a-z0-9]+') if NOT list_contains({1}, x)]"


def _candidate_sql():
    from lodestone.functions.text import STOP_WORDS

    return f"""WITH {LINES_CTE}, qa AS (SELECT i.item_id AS qa_id, min(d.doc_id) AS parent_id, min(i.text) AS question FROM benchmark i LEFT JOIN documents d ON contains({_NORMAL.format('d.text')}, {_NORMAL.format('i.text')}) GROUP BY 1), k AS (SELECT doc_id, sequence, CAST(doc_id AS STRING) || '__C' || lpad(CAST(sequence AS STRING), 4, '0') AS child_id, line FROM lines),
qt AS (SELECT qa_id, parent_id, term, count(*) AS f FROM (SELECT qa_id, parent_id, unnest({_CT.format('question', STOP_WORDS)}) AS term FROM qa) GROUP BY ALL), et AS (SELECT child_id, term, count(*) AS f FROM (SELECT child_id, unnest({_CT.format('line', STOP_WORDS)}) AS term FROM k) GROUP BY ALL),
qn AS (SELECT qa_id, sum(f) AS n, sqrt(CAST(sum(f * f) AS DOUBLE)) AS norm FROM qt GROUP BY 1), en AS (SELECT child_id, sum(f) AS n, sqrt(CAST(sum(f * f) AS DOUBLE)) AS norm FROM et GROUP BY 1),
ov AS (SELECT qa_id, child_id, sum(least(qt.f, et.f)) AS both_, CAST(sum(qt.f * et.f) AS DOUBLE) AS dot FROM qt JOIN k ON k.doc_id = qt.parent_id JOIN et USING (child_id, term) GROUP BY ALL),
sc AS (SELECT qa.qa_id, k.child_id, k.sequence, coalesce(both_ / qn.n, 0) AS recall, coalesce(2.0 * both_ / (qn.n + en.n), 0) AS f1, coalesce(dot / (qn.norm * en.norm), 0) AS cosine, CASE WHEN k.sequence % 7 = 3 THEN 1.0 ELSE 0.0 END AS citation_score FROM qa JOIN k ON k.doc_id = qa.parent_id LEFT JOIN ov ON ov.qa_id = qa.qa_id AND ov.child_id = k.child_id LEFT JOIN qn ON qn.qa_id = qa.qa_id LEFT JOIN en ON en.child_id = k.child_id),
ra AS (SELECT *, round(0.45 * recall + 0.2 * f1 + 0.2 * cosine + 0.15 * citation_score, 6) AS score FROM sc), rk AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, sequence, child_id) AS rank FROM ra)"""


def _qa(t):
    """Benchmark items as questions; the parent is the first document that holds the item."""
    first = _gold(t).groupBy("qa_id").agg(F.min("doc_id").alias("parent_id"))
    items = t.benchmark.select(F.col("item_id").alias("qa_id"), F.col("text").alias("question"), F.lit("").alias("answer"), F.lit("Article 3").alias("citation"))
    return materialized(items.join(first, "qa_id", "left"), "questions")


def _parents(qa):
    return qa.select(F.col("parent_id").alias("doc_id")).distinct()


@query(f"{_candidate_sql()} SELECT qa_id, rank, child_id, score, citation_score, round(recall, 6) AS recall, round(f1, 6) AS f1, round(cosine, 6) AS cosine FROM rk WHERE rank <= 5")
def r06_child_candidates(t):
    qa = _qa(t)
    return mapping.child_candidates(qa, children(t, _parents(qa))).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_candidate_sql()} SELECT qa.qa_id, margin, CASE WHEN rk.qa_id IS NULL THEN 'blocking' WHEN citation_score = 1 AND round(recall, 6) >= 0.45 THEN 'low' WHEN round(recall, 6) >= 0.55 AND margin >= 0.08 THEN 'medium' ELSE 'high' END AS priority FROM qa LEFT JOIN (SELECT *, round(score - coalesce(lead(score) OVER (PARTITION BY qa_id ORDER BY rank), 0), 6) AS margin FROM rk) rk ON rk.qa_id = qa.qa_id AND rank = 1")
def r07_priority(t):
    qa = _qa(t)
    return mapping.review_priority(qa, mapping.child_candidates(qa, children(t, _parents(qa))))


def _evidence_sql():
    """Every child's score for the whole answer (i = -1) and for each of its sentences, and the first mentions of the chosen ones."""
    from lodestone.functions.text import STOP_WORDS

    split = "string_split(regexp_replace(question, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""{_candidate_sql().partition("qt AS (")[0]} src AS (SELECT qa_id, -1 AS i, parent_id, question || ' ' || question AS t FROM qa UNION ALL SELECT qa_id, unnest(generate_series(0, len(l) - 1)), parent_id, unnest(l) FROM (SELECT qa_id, parent_id, [x for x in {split} if trim(x) <> ''] AS l FROM qa)),
qt AS (SELECT qa_id, i, parent_id, term, count(*) AS f FROM (SELECT qa_id, i, parent_id, unnest({_CT.format('t', STOP_WORDS)}) AS term FROM src) GROUP BY ALL), et AS (SELECT child_id, term, count(*) AS f FROM (SELECT child_id, unnest({_CT.format('line', STOP_WORDS)}) AS term FROM k) GROUP BY ALL),
qn AS (SELECT qa_id, i, sum(f) AS n, sqrt(CAST(sum(f * f) AS DOUBLE)) AS norm FROM qt GROUP BY ALL), en AS (SELECT child_id, sum(f) AS n, sqrt(CAST(sum(f * f) AS DOUBLE)) AS norm FROM et GROUP BY 1),
ov AS (SELECT qa_id, i, child_id, sum(least(qt.f, et.f)) AS both_, CAST(sum(qt.f * et.f) AS DOUBLE) AS dot FROM qt JOIN k ON k.doc_id = qt.parent_id JOIN et USING (child_id, term) GROUP BY ALL),
sc AS (SELECT src.qa_id, src.i, k.child_id, k.sequence, coalesce(both_ / qn.n, 0) AS recall, coalesce(2.0 * both_ / (qn.n + en.n), 0) AS f1, coalesce(dot / (qn.norm * en.norm), 0) AS cosine, CASE WHEN k.sequence % 7 = 3 THEN 1.0 ELSE 0.0 END AS cited FROM src JOIN k ON k.doc_id = src.parent_id LEFT JOIN ov ON ov.qa_id = src.qa_id AND ov.i = src.i AND ov.child_id = k.child_id LEFT JOIN qn ON qn.qa_id = src.qa_id AND qn.i = src.i LEFT JOIN en ON en.child_id = k.child_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY qa_id, i ORDER BY score DESC, sequence, child_id) AS rank FROM (SELECT *, round(0.45 * recall + 0.2 * f1 + 0.2 * cosine + 0.15 * cited, 6) AS score FROM sc)),
ch AS (SELECT qa_id, child_id, 0 AS o, 0 AS p FROM rk WHERE i = -1 AND rank = 1 UNION ALL SELECT qa_id, child_id, 1, i FROM rk WHERE i >= 0 AND rank = 1 AND score >= 0.12 UNION ALL SELECT qa_id, child_id, 2, rank FROM rk WHERE i = -1 AND cited = 1),
fm AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY place, child_id) AS n FROM (SELECT qa_id, child_id, min(o * 100000 + p) AS place FROM ch GROUP BY ALL))
SELECT qa_id, string_agg(child_id, ';' ORDER BY n) AS child_ids FROM fm WHERE n <= 6 GROUP BY qa_id"""


@query(_evidence_sql())
def r09_proposed_evidence(t):
    qa = _qa(t).withColumn("answer", F.col("question"))
    return mapping.proposed_evidence(qa, children(t, _parents(qa))).withColumn("child_ids", F.array_join("child_ids", ";"))


def _contexts(t, **config):
    qa = _qa(t)
    ranked = materialized(mapping.child_candidates(qa, children(t, _parents(qa)), 12), "ranked")
    kids = lines(t, _parents(qa)).select(F.concat(F.col("doc_id").cast("string"), F.lit("__C"), F.lpad(F.col("sequence").cast("string"), 4, "0")).alias("child_id"), F.col("doc_id").alias("parent_id"), "sequence", F.size(F.split(F.trim("line"), r"\s+")).alias("word_count"))
    out = context.context_bundles(ranked, kids, **config)
    return out.withColumns({c: F.array_join(c, ";") for c in ("source_ids", "skipped")})


def _context_sql(top: int, words: int, radius: int) -> str:
    """The folds over anchors and neighbours as recursive SQL."""
    return f"""{_candidate_sql().replace("WITH ", "WITH RECURSIVE ", 1)}, wc AS (SELECT child_id, doc_id, sequence, len(regexp_split_to_array(trim(line), '\\s+')) AS words FROM k),
item AS (SELECT rk.qa_id, rk.rank, wc.child_id, wc.doc_id, wc.sequence, wc.words FROM rk JOIN wc USING (child_id) WHERE rank <= 12),
an AS (SELECT DISTINCT qa_id, CAST(0 AS BIGINT) AS rank, CAST([] AS STRING[]) AS taken, CAST([] AS BIGINT[]) AS ranks, CAST(0 AS BIGINT) AS words, CAST([] AS STRING[]) AS skipped FROM item
UNION ALL SELECT qa_id, rank, CASE WHEN f OR o THEN taken ELSE taken || [child_id] END, CASE WHEN f OR o THEN ranks ELSE ranks || [rank] END, CASE WHEN f OR o THEN words ELSE words + w END, CASE WHEN NOT f AND o THEN skipped || [child_id] ELSE skipped END
FROM (SELECT an.qa_id, taken, ranks, an.words, skipped, item.rank, item.child_id, item.words AS w, len(taken) >= {top} AS f, len(taken) > 0 AND an.words + item.words > {words} AS o FROM an JOIN item ON item.qa_id = an.qa_id AND item.rank = an.rank + 1)),
done AS (SELECT an.* FROM an JOIN (SELECT qa_id, max(rank) AS rank FROM item GROUP BY 1) USING (qa_id, rank)),
near AS (SELECT qa_id, row_number() OVER (PARTITION BY qa_id ORDER BY i.rank, wc.sequence) AS n, i.rank AS r, wc.child_id, wc.doc_id, wc.sequence, wc.words FROM done JOIN item i USING (qa_id) JOIN wc ON wc.doc_id = i.doc_id AND abs(wc.sequence - i.sequence) <= {radius} WHERE list_contains(done.taken, i.child_id) AND {radius} > 0),
ne AS (SELECT qa_id, CAST(0 AS BIGINT) AS n, taken, ranks, len(taken) AS anchors, words, skipped FROM done
UNION ALL SELECT qa_id, n, CASE WHEN h OR o THEN taken ELSE taken || [child_id] END, CASE WHEN h OR o THEN ranks ELSE ranks || [r] END, anchors, CASE WHEN h OR o THEN words ELSE words + w END, CASE WHEN NOT h AND o THEN skipped || [child_id] ELSE skipped END
FROM (SELECT ne.qa_id, near.n, taken, ranks, anchors, ne.words, skipped, near.r, near.child_id, near.words AS w, list_contains(taken, near.child_id) AS h, ne.words + near.words > {words} AS o FROM ne JOIN near ON near.qa_id = ne.qa_id AND near.n = ne.n + 1)),
fin AS (SELECT ne.* FROM ne JOIN (SELECT qa_id, max(n) AS n FROM ne GROUP BY 1) USING (qa_id, n)),
flat AS (SELECT qa_id, unnest(taken) AS child_id, unnest(ranks) AS r FROM fin)
SELECT qa_id, (SELECT string_agg(flat.child_id, ';' ORDER BY flat.r, CAST(wc.doc_id AS STRING), wc.sequence, flat.child_id) FROM flat JOIN wc USING (child_id) WHERE flat.qa_id = fin.qa_id) AS source_ids, CAST(anchors AS INT) AS anchor_count, CAST(len(taken) - anchors AS INT) AS neighbor_count, CAST(words AS INT) AS evidence_words, array_to_string(skipped, ';') AS skipped FROM fin"""


@query(_context_sql(5, 1200, 0))
def r10_w15_context(t):
    return _contexts(t)


@query(_context_sql(5, 300, 1))
def w16_context_neighbours(t):
    return _contexts(t, radius=1, max_words=300)


@query("""SELECT conv_id AS qa_id, string_agg('[SOURCE ' || CAST(turn AS STRING) || ']' || chr(10) || 'Citation: ' || role || chr(10) || 'Document: d (t)' || chr(10) || 'Version: v' || chr(10) || 'Hierarchy: a > b' || chr(10) || 'Evidence: ' || text, chr(10) || chr(10) ORDER BY turn) AS prompt_context FROM (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def p19_prompt_context(t):
    own = t.conversations.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return context.prompt_context(own.select(F.col("conv_id").alias("qa_id"), F.col("turn").alias("position"), F.col("turn").cast("string").alias("source_id"), F.col("role").alias("citation"), F.lit("d").alias("document_id"), F.lit("t").alias("document_type"), F.lit("v").alias("version"), F.array(F.lit("a"), F.lit("b")).alias("path"), "text"))


def _answers(t):
    """Answers about benchmark items: each cites its own text, a changed text, or an unknown source."""
    evidence = t.benchmark.select(F.col("item_id").alias("qa_id"), F.lit("S1").alias("source_id"), "text", F.lit("Article 1").alias("canonical_citation"), F.lit("D").alias("document_id"), F.lit("P").alias("parent_id"))
    k = F.col("item_id") % 4
    quote = F.when(k == 1, F.concat(F.left("text", F.lit(10)), F.lit("... x"))).otherwise(F.left("text", F.lit(40)))
    support = F.struct(F.when(k == 2, "S9").otherwise("S1").alias("source_id"), quote.alias("quote"))
    claim = F.struct(F.lit("c1").alias("claim_id"), F.lit("claim").alias("text"), F.array(support).alias("supports"))
    payload = F.to_json(F.struct(F.lit("a").alias("answer_text"), (k == 3).alias("abstain"), F.when(k == 3, "outside_corpus").alias("abstention_reason"), F.array(claim).alias("claims")))
    return t.benchmark.select(F.col("item_id").alias("qa_id"), F.parse_json(payload).alias("payload")), evidence


@query("SELECT item_id AS qa_id, CASE item_id % 4 WHEN 0 THEN 'accept_structurally' WHEN 3 THEN 'abstain' ELSE 'retry_or_abstain' END AS decision, item_id % 4 <> 2 AS structural_pass, item_id % 4 <> 1 AS quote_pass FROM benchmark")
def n01_n02_verify(t):
    return answers.verify(*_answers(t)).select("qa_id", "decision", "structural_pass", "quote_pass")


@query("SELECT item_id AS qa_id, CAST(1 AS BIGINT) AS position, 'S1' AS source_id, 'Article 1' AS canonical_citation FROM benchmark WHERE item_id % 4 <> 2")
def n03_resolve_citations(t):
    return answers.resolve_citations(*_answers(t)).select("qa_id", F.col("position").cast("long").alias("position"), "source_id", "canonical_citation")


@query("SELECT count(*) AS n, count(*) FILTER (item_id % 4 <> 2) AS structural, count(*) FILTER (item_id % 4 <> 1) AS quote FROM benchmark")
def a10_generation_summary(t):
    return answers.generation_summary(materialized(answers.verify(*_answers(t)), "reports")).select("n", "structural", "quote")


@query("SELECT item_id AS qa_id, CASE WHEN item_id % 3 = 0 THEN 'reworded' ELSE 'question' END AS question, item_id % 3 = 0 AS source_record_changed, CASE item_id % 3 WHEN 0 THEN 'human_review_corrected' WHEN 1 THEN 'human_review_accepted' ELSE 'provisional' END AS audit_decision, CAST(CASE item_id % 3 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS sets FROM benchmark WHERE item_id % 7 <> 1 OR item_id % 3 = 2")
def n04_apply_review(t):
    candidates = t.benchmark.select(F.col("item_id").cast("string").alias("qa_id"), F.lit("question").alias("question"), F.lit("answer").alias("reference_answer"), F.lit("Article 1").alias("acceptable_citation"), F.lit("P1").alias("parent_id"), F.array(F.lit("C1")).alias("gold_child_ids"), F.lit("provisional").alias("audit_decision"))
    k = F.col("item_id") % 3
    decision = F.when(F.col("item_id") % 7 == 1, "exclude").when(k == 0, "correct").otherwise("accept")
    empty = ("alternative_acceptable_child_ids", "corrected_reference_answer", "corrected_citation", "corrected_parent_id", "corrected_gold_child_ids", "review_notes")
    rows = t.benchmark.where(k != 2).select(
        F.col("item_id").cast("string").alias("qa_id"),
        decision.alias("reviewer_decision"),
        F.when(k == 0, " reworded ").otherwise("").alias("corrected_question"),
        F.when(k == 0, '[["C2"]]').otherwise("").alias("alternative_evidence_sets_json"),
        F.lit("").alias("corrected_evidence_sets_json"),
        *(F.lit("").alias(c) for c in empty),
        F.lit("r").alias("reviewer_name_or_role"),
        F.lit("2026-01-01").alias("review_date"),
    )
    kids = t.spark.createDataFrame([("C1", "P1"), ("C2", "P2")], "child_id string, parent_id string")
    out = review.apply_decisions(candidates, rows, kids)
    return out.select(F.col("qa_id").cast("long").alias("qa_id"), "question", "source_record_changed", "audit_decision", F.size("acceptable_evidence_sets").cast("long").alias("sets"))


@query("SELECT CAST(doc_id AS STRING) AS qa_id, 'review_date must use YYYY-MM-DD' AS error FROM labels WHERE doc_id % 5 = 0 UNION ALL SELECT CAST(doc_id AS STRING), 'accept requires all four checks to be yes' FROM labels WHERE quality = 0 UNION ALL SELECT CAST(doc_id AS STRING), 'missing required review row' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def f06_review_errors(t):
    check = F.when(F.col("quality") == 1, "yes").otherwise("no")
    empty = ("alternative_acceptable_child_ids", "alternative_evidence_sets_json", *review.CORRECTED)
    rows = t.labels.select(F.col("doc_id").cast("string").alias("qa_id"), F.lit("accept").alias("reviewer_decision"), check.alias(review.CHECKS[0]), *(F.lit("yes").alias(c) for c in review.CHECKS[1:]), F.when(F.col("doc_id") % 5 == 0, "1.1.2026").otherwise("2026-01-01").alias("review_date"), F.lit("r").alias("reviewer_name_or_role"), *(F.lit("").alias(c) for c in empty))
    ids = t.documents.select(F.col("doc_id").cast("string").alias("qa_id"))
    return review.review_errors(rows, ids, t.spark.createDataFrame([], "child_id string, parent_id string"), ids)


@query("SELECT CAST(item AS STRING) AS qa_id, n_reviewers, votes_accept, panel_verdict FROM (SELECT user_id % 40 AS item, count(DISTINCT user_id) AS n_reviewers, count(*) FILTER (event_type = 'click') AS votes_accept, arg_min(event_type, (-c, m)) AS v, CASE WHEN arg_min(m, (-c, m)) IS NULL THEN '' ELSE arg_min(m, (-c, m)) END AS panel_verdict FROM (SELECT *, count(*) OVER (PARTITION BY user_id % 40, m) AS c FROM (SELECT *, CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'correct' ELSE 'exclude' END AS m FROM events)) GROUP BY 1)")
def n07_a12_panel(t):
    value = F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "view", "correct").otherwise("exclude")
    cast = t.events.select((F.col("user_id") % 40).cast("string").alias("qa_id"), F.col("user_id").alias("rater"), F.lit("Q5").alias("question"), value.alias("value"))
    return review.panel(cast.select("qa_id").distinct(), cast).select("qa_id", "n_reviewers", "votes_accept", "panel_verdict")


def _signals_sql() -> str:
    fired = ", ".join(f"{{'rule': '{rule}', 'fired': {condition}}}" for rule, condition in calibration.RULES.items())
    z, zz = "CAST(1.96 AS DOUBLE)", f"CAST({1.96 * 1.96!r} AS DOUBLE)"
    low = f"(p + {zz} / (2 * e) - {z} * sqrt(p * (1 - p) / e + {zz} / (4 * e * e))) / (1 + {zz} / e)"
    high = low.replace(f" - {z} * sqrt", f" + {z} * sqrt")
    return f"""WITH {_BM25.format(b=0.75)}, {_GOLD}, top AS (SELECT qa_id, id, CAST(id AS STRING) AS c, score, rank FROM rk WHERE rank <= 20),
sh AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY s DESC, c) AS r FROM (SELECT qa_id, c, rank AS o, round(score * (rank % 3 + 1), 6) AS s FROM top)),
sg AS (SELECT qa_id, round(max(s) FILTER (r = 1) - coalesce(max(s) FILTER (r = 2), 0), 6) AS rerank_margin, abs(max(o) FILTER (r = 1) - 1) AS top1_rank_shift FROM sh GROUP BY qa_id),
ci AS (SELECT qa_id, list(id) AS cited FROM top WHERE rank <= 3 GROUP BY qa_id),
si AS (SELECT rerank_margin, top1_rank_shift, len(list_distinct(cited)) AS distinct_sources_cited, len(cited) AS claim_count, CASE WHEN qa_id % 3 > 0 THEN 1 ELSE 0 END AS quote_pass, CASE WHEN qa_id % 2 > 0 THEN 1 ELSE 0 END AS quote_pass_strict, 0 AS model_abstained, len(list_intersect(cited, ids)) = 0 AS error FROM sg JOIN ci USING (qa_id) JOIN gold USING (qa_id)),
fi AS (SELECT f.rule, f.fired, error FROM (SELECT unnest([{fired}]) AS f, error FROM si)),
co AS (SELECT rule, count(*) AS n, count(*) FILTER (fired) AS escalated, count(*) FILTER (fired AND error) AS errors_caught, count(*) FILTER (error) AS errors FROM fi GROUP BY rule),
wi AS (SELECT *, nullif(CAST(escalated AS DOUBLE), 0) AS e, errors_caught / nullif(CAST(escalated AS DOUBLE), 0) AS p FROM co)
SELECT rule, escalated, round(escalated / n, 4) AS escalation_rate, errors_caught, round(p, 4) AS precision, round({low}, 4) AS ci_low, round({high}, 4) AS ci_high, CASE WHEN errors > 0 THEN round(errors_caught / errors, 4) END AS recall, coalesce({low} > errors / n, false) AS beats_base_rate FROM wi"""


@query(_signals_sql())
def r13_n09_signals(t):
    ranked = materialized(_bm25(t), "ranked").select("qa_id", F.col("id").cast("string").alias("child_id"), (F.col("id") % 10).cast("string").alias("parent_id"), "score", "rank")
    shuffled = retrieval.top_k(ranked.withColumn("original_rank", F.col("rank")).drop("rank").withColumn("score", F.round(F.col("score") * (F.col("original_rank") % 3 + 1), 6)), ["qa_id"], [F.desc("score"), F.asc("child_id")], 20)
    said = ranked.where("rank <= 3").groupBy("qa_id").agg(F.collect_list("child_id").alias("cited"))
    made = questions(t).join(said, "qa_id").select("qa_id", F.lit("development").alias("split"), F.col("question").alias("answer_text"), F.size("cited").alias("claim_count"), "cited", (F.col("qa_id") % 3 > 0).alias("quote_pass"), (F.col("qa_id") % 2 > 0).alias("quote_pass_strict"), F.lit(False).alias("elided"), F.lit(False).alias("abstained"))
    gold = _gold(t).groupBy("qa_id").agg(F.collect_list(F.col("doc_id").cast("string")).alias("gold_child_ids"), F.collect_list((F.col("doc_id") % 10).cast("string")).alias("acceptable_parent_ids"))
    return calibration.rule_statistics(materialized(calibration.signals(made, shuffled, ranked, gold), "signals"))


@query()
def n08_rescore(t):
    bench = t.documents.select(F.col("doc_id").alias("qa_id"), F.lit("test").alias("split"), F.lit("q").alias("question"), F.col("text").alias("reference_answer"), F.concat(F.lit("Article "), (F.col("doc_id") % 9).cast("string")).alias("acceptable_citation"), F.array(F.lit("P")).alias("acceptable_parent_ids"))
    results = t.documents.select(F.col("doc_id").cast("string").alias("result_id"), F.lit("rag").alias("system"), F.lit("5").alias("variant"), F.col("doc_id").alias("qa_id"), F.when(F.col("doc_id") % 10 == 0, "other").otherwise(" Q ").alias("question"), F.concat(F.expr(CITED), F.lit(" "), F.col("text")).alias("prediction"), F.array("lang").alias("retrieved_chunks"))
    parents = t.spark.range(0, 9).select(F.concat(F.lit("EU_376_2014_ART_"), "id").alias("parent_id"))
    chunk = t.spark.createDataFrame([("en", "P"), ("de", "Q")], "chunk_id string, parent_id string")
    return baselines.aggregate(materialized(baselines.rescore(results, bench, parents, chunk), "rescored"))


@query("SELECT CAST(doc_id AS STRING) AS key, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE upper(lang) END AS response, doc_id % 3 = 0 AS cached FROM documents")
def s11_s14_response_cache(t):
    requests = t.documents.select(F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("request"))
    cache = t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("key"), F.lit("old").alias("response"))
    return baselines.through_cache(requests, cache, lambda texts: [x.upper() for x in texts])


@query(f"SELECT doc_id, doc_id % 3 = 0 AS cached, CAST(64 AS BIGINT) AS size, CASE WHEN len({TOK.format('text')}) > 0 THEN 1.0 ELSE 0.0 END AS norm, true AS matched FROM documents")
def s11_s12_vector_cache(t):
    """Vectors of all documents from a cache that has every third one's, which then matches as it is. Another text's vector is asked for."""
    at = f"{shared_dir(t.spark)}/vectors-{uuid.uuid4().hex}"
    mark = F.translate(F.col("doc_id").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")  # the id in digits that are no token, so that no two texts are alike
    rows = t.documents.select(F.col("doc_id").alias("id"), F.concat(mark, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    providers.cached_vectors(rows.where("id % 3 = 0"), at, "hashed", providers.hashed_vectors())
    got, before = providers.cached_vectors(rows, at, "hashed", providers.hashed_vectors())
    _, after = providers.cached_vectors(rows, at, "hashed", providers.hashed_vectors())
    norm = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 6)
    return got.select(F.col("id").alias("doc_id"), "cached", F.size("embedding").cast("long").alias("size"), norm.alias("norm"), F.lit(after and not before).alias("matched"))


@query(f"SELECT item_id AS qa_id, doc_id AS id, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS score FROM (SELECT item_id, doc_id, {TOK.format('i.text')} AS a, {TOK.format('d.text')} AS b FROM benchmark i JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = i.item_id)")
def s13_pair_scores(t):
    pairs = t.documents.select(F.col("doc_id").alias("id"), "text").join(questions(t), F.col("id") % t.benchmark.count() == F.col("qa_id"))
    return providers.scored_pairs(pairs, providers.lexical_scores).select("qa_id", "id", F.round("score", 6).alias("score"))


@query("SELECT item_id AS qa_id, item_id % 4 = 0 AS cached, CASE WHEN item_id % 4 = 3 THEN 'abstain' ELSE 'accept_structurally' END AS decision, item_id % 4 <> 3 AS cited FROM benchmark")
def s15_generated_answers(t):
    """Answers of the offline provider to benchmark items, whose source is the item itself or, for every fourth, a text without a common word."""
    _, evidence = _answers(t)
    given = evidence.withColumn("position", F.lit(1)).withColumn("text", F.when(F.col("qa_id") % 4 == 3, F.lit("§ §")).otherwise(F.regexp_replace("text", r"[^\p{L}\p{N} ]", "")))
    asked = t.benchmark.select(F.col("item_id").alias("qa_id"), F.concat(F.lit("7q "), F.col("text")).alias("question"))
    first = flows.generate(asked.where("qa_id % 4 = 0"), given, providers.extracted_answers, t.spark.createDataFrame([], "key string, response string"))
    out = flows.generate(asked, given, providers.extracted_answers, first["answers"].select("key", F.col("payload").alias("response")))
    cited = out["citations"].select("qa_id", F.lit(True).alias("cited")).distinct()
    return out["answers"].select("qa_id", "cached").join(out["reports"].select("qa_id", "decision"), "qa_id").join(cited, "qa_id", "left").select("qa_id", "cached", "decision", F.coalesce("cited", F.lit(False)).alias("cited"))


@query("SELECT term, count(*) AS df, CAST(sum(f) AS BIGINT) AS total, round(avg(len), 6) AS mean_len FROM (SELECT doc_id, len, term, count(*) AS f FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)) GROUP BY ALL) GROUP BY term")
def a01_a03_term_statistics(t):
    tf = retrieval.term_frequencies(t.documents, "doc_id", "text")
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("f").alias("total"), F.round(F.avg("len"), 6).alias("mean_len"))


@query("SELECT item_id AS qa_id, item_id % 4 <> 2 AS usable, CASE WHEN item_id % 4 <> 2 THEN item_id % 4 <> 1 END AS grounded, item_id % 4 = 1 AS elided FROM benchmark")
def t09_t12_j16_grounding(t):
    return answers.grounded_supports(*_answers(t)).select("qa_id", "usable", "grounded", "elided")


@query("SELECT doc_id AS id, CAST(len(list_distinct(['2' || CAST(doc_id % 9 AS STRING), '1' || CAST(doc_id % 5 AS STRING), '14'])) AS BIGINT) AS cited, CAST(4 AS BIGINT) AS most FROM documents")
def j18_citation_candidates(t):
    cited = citations.citations(t.documents.select(F.col("doc_id").alias("id"), F.expr(CITED).alias("text"))).drop("text")
    parents = t.spark.range(0, 9).select(F.explode(F.array(*(F.concat(F.lit(f"{p}_ART_"), "id") for p in citations.REGULATIONS.values()))).alias("parent_id"))
    found = citations.candidates(cited, parents)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("cited"), F.max(F.size("parent_ids")).cast("long").alias("most"))


def _word_document(t):
    """Documents as Word files of 1,000 ids each: a known heading, an article for each document, its lines as paragraphs and a two-row table; returns their folder."""
    safe = F.regexp_replace("text", "[&<>]", "")
    p = lambda text, style: F.concat(F.lit(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t xml:space="preserve">'), text, F.lit("</w:t></w:r></w:p>"))
    body = F.array_join(F.transform(F.split(safe, "\n"), lambda x: p(x, "ListLevel1")), "")
    cell = lambda text, style: F.concat(F.lit("<w:tc>"), p(text, style), F.lit("</w:tc>"))
    rows = F.concat(F.lit("<w:tbl><w:tr>"), cell(F.lit("Lang"), "TableHead"), cell(F.lit("Source"), "TableHead"), F.lit("</w:tr><w:tr>"), cell(F.col("lang"), ""), cell(F.col("source"), ""), F.lit("</w:tr></w:tbl>"))
    article = F.concat(p(F.concat(F.lit("Article "), F.col("doc_id").cast("string"), F.lit(" Title")), "Heading3CR"), body, rows)
    start = F.concat(F.lit('<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'), p(F.lit("Regulation (EU) No 376/2014"), "Heading1"), p(F.lit("Terms"), "Heading2"))
    at = f"{shared_dir(t.spark)}/word-{uuid.uuid4().hex}"
    dealt = t.documents.select(F.floor(F.col("doc_id") / 1000).alias("block"), "doc_id", "text", "lang", "source").repartition("block")  # a file for each block; texts are shuffled without their markup
    listed = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("doc_id", article.alias("a")))).alias("l"))
    whole = listed.select("block", F.concat(start, F.array_join(F.transform("l", lambda x: x["a"]), ""), F.lit("</w:body></w:document>")).alias("value"))
    whole.write.partitionBy("block").text(at)
    return f"{at}/*/*.txt"


@query("SELECT (SELECT CAST(sum(len([x for x in string_split(regexp_replace(text, '[&<>]', '', 'g'), chr(10)) if trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''])) AS BIGINT) + count(*) + 2 * count(DISTINCT doc_id // 1000) FROM documents) AS paragraphs, (SELECT 2 * count(*) FROM documents) AS table_rows, (SELECT count(*) FROM documents) AS headers")
def s01_s05_word_blocks(t):
    blocks = wordml.read_blocks(t.spark, _word_document(t))
    return blocks.agg(F.count_if(F.col("kind") == "p").alias("paragraphs"), F.count_if(F.col("kind") == "tr").alias("table_rows"), F.count_if("is_header").alias("headers"))


@query("SELECT 'EU_376_2014_ART_' || CAST(doc_id AS STRING) AS parent_id, 'Article ' || CAST(doc_id AS STRING) AS canonical_citation, CAST(len([x for x in string_split(regexp_replace(text, '[&<>]', '', 'g'), chr(10)) if trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '']) + 2 AS BIGINT) AS children FROM documents")
def n05_corpus_build(t):
    parents, _, _ = corpus.build(wordml.read_blocks(t.spark, _word_document(t)))
    return parents.select("parent_id", "canonical_citation", F.size("child_ids").cast("long").alias("children"))


@query(f"""WITH RECURSIVE {split_sql("SELECT 'P' || CAST(item_id % 15 AS STRING) AS g, count(*) AS n FROM benchmark WHERE item_id % 9 <> 0 GROUP BY 1")} SELECT CAST(item_id AS STRING) AS qa_id, st.g AS parent_id, split FROM benchmark JOIN st ON st.g = 'P' || CAST(item_id % 15 AS STRING) WHERE item_id % 9 <> 0""")
def n06_freeze(t):
    candidates = t.benchmark.select(F.col("item_id").cast("string").alias("qa_id"), F.lit("q").alias("question"), F.lit("a").alias("reference_answer"), F.lit("Article 1").alias("acceptable_citation"), F.concat(F.lit("P"), F.col("item_id") % 15).alias("parent_id"), F.array(F.concat(F.lit("C"), F.col("item_id") % 15)).alias("gold_child_ids"), F.lit("provisional").alias("audit_decision"))
    empty = ("alternative_acceptable_child_ids", "alternative_evidence_sets_json", *review.CORRECTED, "review_notes")
    rows = t.benchmark.select(F.col("item_id").cast("string").alias("qa_id"), F.when(F.col("item_id") % 9 == 0, "exclude").otherwise("accept").alias("reviewer_decision"), *(F.lit("yes").alias(c) for c in review.CHECKS), *(F.lit("").alias(c) for c in empty), F.lit("r").alias("reviewer_name_or_role"), F.lit("2026-01-01").alias("review_date"))
    kids = t.benchmark.select(F.concat(F.lit("C"), F.col("item_id") % 15).alias("child_id"), F.concat(F.lit("P"), F.col("item_id") % 15).alias("parent_id")).distinct()
    return flows.freeze(candidates, rows, kids).select("qa_id", "parent_id", "split")
