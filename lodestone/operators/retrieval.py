"""Ranking: BM25, cosine top-k, reciprocal rank fusion, reranking, and the metrics of rankings.

Rankings are long tables (qa_id, rank, id, ...); nesting is left to sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import lexical_tokens, token_runs
from lodestone.operators import cells
from lodestone.sources.shared import materialized

#: Distinct query terms that may be broadcast.
MAX_TERMS = 500_000


def top_k(scored: DataFrame, group: list[str], order: list[Column], limit: int | None, rank: str = "rank") -> DataFrame:
    """scored with its rank within group, the first limit of each."""
    ranked = scored.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked if limit is None else ranked.where(F.col(rank) <= limit)


def term_frequencies(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, term, f) and the length of each text as a column len."""
    own = docs.select(F.col(id_column).alias("id"), lexical_tokens(F.col(text_column)).alias("t"))
    return own.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("f"))


def index(docs: DataFrame, doc_id: str = "id", doc_text: str = "text") -> DataFrame:
    """A written table (id, len, runs) of documents: their tokens, counted once. It serves any questions and parameters of bm25."""
    own = docs.select(F.col(doc_id).alias("id"), lexical_tokens(F.coalesce(F.col(doc_text), F.lit(""))).alias("t"))
    return materialized(own.select("id", F.size("t").alias("len"), token_runs(F.col("t")).alias("runs")), "index")


def postings(asked: DataFrame, whole: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(id, *more, term, f) of an index for the terms of asked, as a written table, and (term, number, df) of these terms, to join."""
    terms = asked.select("term").distinct()
    few = terms.count() <= MAX_TERMS
    held = whole.select("id", *more, F.inline("runs")).join(F.broadcast(terms) if few else terms, "term", "left_semi")  # before anything is shuffled
    held = materialized(held, "postings")
    counted = held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", F.monotonically_increasing_id().alias("number"), "df")
    counted = materialized(counted, "terms")
    return held, F.broadcast(counted) if few else counted


def with_bars(questions: DataFrame, documents: DataFrame, gain: Column, by: str, limit: int) -> DataFrame:
    """questions (q, term, df, ...) without df, with bar: a score that the limit-th best document of each question reaches; null where that is not known.

    A question's rarest terms, as far as they have 5 limit documents together, name documents (of a commoner one only the
    5 limit best); twice limit of these, those with the best sums, are scored in full. So a question joins no more than
    10 limit rows to find them.
    """
    reach = 5 * limit
    upto = Window.partitionBy("q").orderBy("df", "term")
    rare = questions.withColumn("before", F.sum(F.least("df", F.lit(reach))).over(upto) - F.least("df", F.lit(reach))).where(F.col("before") < reach).drop("before")
    few = documents.join(rare.select("term").distinct(), "term", "left_semi")
    best = top_k(few, ["term"], [F.desc(by), F.asc("id")], reach).drop("rank")  # limited before the shuffle too
    sums = rare.join(best, "term").groupBy("q", "id").agg(F.sum(gain).alias("least"))
    seeds = top_k(sums, ["q"], [F.desc("least"), F.asc("id")], 2 * limit).select("q", "id")
    scored = documents.join(seeds, "id").join(questions, ["q", "term"]).groupBy("q", "id").agg(F.sum(gain).alias("score"))
    bars = top_k(scored, ["q"], [F.desc("score"), F.asc("id")], limit).groupBy("q").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
    return questions.drop("df").join(bars.select("q", "bar"), "q", "left")


def bm25_cells(asked: DataFrame, whole: DataFrame, limit: int, k1: float, b: float) -> DataFrame:
    """(q, id, score, weight, entries) of the limit best documents of each question of asked (qa_id, term, qf) in each cell of an index, without those that other cells surely beat."""
    n, mean = whole.agg(F.count(F.lit(1)), F.avg("len")).first()
    held, terms = postings(asked, whole, "len")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    questions = asked.join(terms, "term").select(F.col("qa_id").alias("q"), F.col("number").alias("term"), (idf * F.col("qf")).alias("weight"), "df")
    part = F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / (mean or 1.0)))
    documents = held.join(terms, "term").select("id", F.col("number").alias("term"), part.alias("part"))
    questions = materialized(questions, "asked")
    questions = materialized(with_bars(questions, documents, F.col("weight") * F.col("part"), "part", limit), "questions")
    return cells.top_by_terms(questions, documents, held.count(), lambda w, v: w * v, [1.0], limit, ["weight"])


def bm25(queries: DataFrame, docs: DataFrame, limit: int = 20, k1: float = 1.5, b: float = 0.75, query_id: str = "qa_id", query_text: str = "question", doc_id: str = "id", doc_text: str = "text") -> DataFrame:
    """(qa_id, id, score, rank) of the limit best documents of each query; score is rounded to 8 digits, ties go by id.

    docs: documents, or their index. Documents that share no term with a query score 0 and fill the ranking up, by id.
    ValueError for parameters or an empty corpus that define no score.
    """
    if limit < 1 or k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("limit and k1 must be positive, b between 0 and 1")
    whole = docs if {"id", "len", "runs"} <= {*docs.columns} else index(docs, doc_id, doc_text)
    if whole.isEmpty():
        raise ValueError("no documents")
    asked = queries.select(F.col(query_id).alias("qa_id"), F.explode(lexical_tokens(F.col(query_text))).alias("term")).groupBy("qa_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    scored = bm25_cells(materialized(asked, "asked"), whole, limit, k1, b).select(F.col("q").alias("qa_id"), "id", F.round("score", 8).alias("score"))
    best = materialized(top_k(scored, ["qa_id"], [F.desc("score"), F.asc("id")], limit), "best")
    found = best.groupBy("qa_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("id").alias("ids"))
    short = queries.select(F.col(query_id).alias("qa_id")).join(found, "qa_id", "left").where(F.coalesce("n", F.lit(0)) < limit)
    fill = whole.select("id").orderBy("id").limit(2 * limit)  # limit ids at most are taken already
    padded = short.join(F.broadcast(fill)).where(~F.coalesce(F.array_contains("ids", F.col("id")), F.lit(False)))
    padded = top_k(padded.select("qa_id", "id", F.lit(0.0).alias("score"), F.coalesce("n", F.lit(0)).alias("n")), ["qa_id"], [F.asc("id")], limit)
    return best.unionByName(padded.withColumn("rank", F.col("rank") + F.col("n")).where(F.col("rank") <= limit).select("qa_id", "id", "score", "rank"))


def unit_vector(v: Column) -> Column:
    """v as doubles of length one; an error for a zero vector."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("zero vector")).cast("double")))


def cosine_top_k(queries: DataFrame, docs: DataFrame, limit: int, query_id: str = "q", doc_id: str = "id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(q, id, score, rank): the limit documents nearest each query by cosine, ties by id.

    Blocks of queries meet blocks of documents, each pair once, in a matrix product that lets out the best limit of each
    query; both tables are read once for any number of queries.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    asked = queries.select(F.col(query_id).alias("q"), unit_vector(F.col(vector)).alias("v"))
    own = docs.select(F.col(doc_id).alias("id"), unit_vector(F.col(vector)).alias("v"))
    return top_k(cells.top_by_vectors(asked, own, limit, exclude_self), ["q"], [F.desc("score"), F.asc("id")], limit)


def reciprocal_rank_fusion(rankings: DataFrame, constant: float = 60, limit: int | None = None) -> DataFrame:
    """(qa_id, id, score, best_rank, rank) of rankings (ranker, weight, qa_id, rank, id).

    A ranker's first mention of an id counts, with its rank; order is score, best rank, id.
    """
    if constant < 0 or limit is not None and limit < 1:
        raise ValueError("constant must not be negative, limit must be positive")
    first = rankings.groupBy("ranker", "weight", "qa_id", "id").agg(F.min("rank").alias("rank"))
    checked = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.raise_error(F.lit("weights must be positive")).cast("double"))
    fused = first.groupBy("qa_id", "id").agg(F.round(F.sum(checked / (constant + F.col("rank"))), 10).alias("score"), F.min("rank").alias("best_rank"))
    return top_k(fused, ["qa_id"], [F.desc("score"), F.asc("best_rank"), F.asc("id")], limit)


def rerank(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """candidates (qa_id, id, original_rank, score) in the order of score, original rank, id."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    return top_k(candidates, ["qa_id"], [F.desc("score"), F.asc("original_rank"), F.asc("id")], limit)


def evaluate(qa: DataFrame, rankings: DataFrame, parents: DataFrame, ks: list[int], split: str | None = "split") -> DataFrame:
    """Metrics by k, and by split and k: n, parent_recall, any_gold_recall, evidence_recall, mrr, ndcg.

    qa: qa_id, evidence_sets array<array<id>>, parent_ids array, and split; rankings: qa_id, rank, id; parents: id, parent_id.
    A record without evidence is an error. Rows whose split is null stand for all splits.
    """
    sets = F.filter("evidence_sets", lambda s: F.size(s) > 0)
    checked = F.when(F.size(sets) > 0, sets).otherwise(F.raise_error(F.lit("no acceptable evidence")).cast(qa.schema["evidence_sets"].dataType))
    gold = qa.select("qa_id", *([F.col(split).alias("split")] if split else [F.lit("all").alias("split")]), checked.alias("sets"), "parent_ids")
    known = rankings.join(parents, "id", "left").groupBy("qa_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "parent_id"))).alias("ranked"))
    each = gold.join(known, "qa_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast(known.schema["ranked"].dataType))).withColumn("k", F.explode(F.array(*map(F.lit, sorted(set(ks))))))
    each = each.withColumn("top", F.filter("ranked", lambda r: r["rank"] <= F.col("k"))).withColumn("golden", F.array_distinct(F.flatten("sets")))
    each = each.withColumn("hits", F.transform(F.filter("top", lambda r: F.array_contains("golden", r["id"])), lambda r: r["rank"])).withColumn("found", F.transform("top", lambda r: r["id"]))

    def dcg(ranks):
        return F.aggregate(ranks, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))

    measured = each.select(
        "split",
        "k",
        F.exists("top", lambda r: F.array_contains("parent_ids", r["parent_id"])).cast("double").alias("parent_recall"),
        (F.size("hits") > 0).cast("double").alias("any_gold_recall"),
        F.array_max(F.transform("sets", lambda s: F.size(F.array_intersect(F.array_distinct(s), "found")) / F.size(F.array_distinct(s)))).alias("evidence_recall"),
        F.coalesce(1.0 / F.array_min("hits"), F.lit(0.0)).alias("mrr"),
        (dcg(F.col("hits")) / dcg(F.sequence(F.lit(1), F.least(F.size("golden"), F.col("k"))))).alias("ndcg"),
    )
    names = ["parent_recall", "any_gold_recall", "evidence_recall", "mrr", "ndcg"]
    keys = [F.col("split"), F.col("k")]
    return measured.groupingSets([keys, keys[1:]], *keys).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in names))
