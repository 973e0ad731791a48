"""Mapping evidence: lexical child candidates, review priority, chunk lineage and proposed evidence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import citation_score, content_tokens, let, lexical_tokens, sentences, token_runs
from lodestone.operators import cells
from lodestone.operators.retrieval import index, postings, top_k, with_bars
from lodestone.sources.shared import materialized


def overlap(pairs: DataFrame, query: Column, evidence: Column) -> DataFrame:
    """pairs with recall, f1 and cosine of the token arrays query and evidence, zero where either is empty.

    Both are sorted runs of tokens; put together and sorted by token, shared tokens are neighbours.
    """

    def merged(q, e):
        both = F.array_sort(F.concat(F.transform(q, lambda x: F.struct(x["term"].alias("term"), F.lit(0).alias("side"), x["f"].alias("f"))), F.transform(e, lambda x: F.struct(x["term"].alias("term"), F.lit(1).alias("side"), x["f"].alias("f")))))
        return let(both, lambda b: F.filter(F.transform(b, lambda x, i: F.when(x["term"] == F.get(b, i + 1)["term"], F.struct(x["f"].alias("a"), F.get(b, i + 1)["f"].alias("b")))), lambda x: x.isNotNull()))

    def total(items, f):
        return F.aggregate(items, F.lit(0.0), lambda a, x: a + f(x))

    def norm(runs):
        return F.sqrt(total(runs, lambda x: x["f"].cast("double") * x["f"]))

    own = pairs.withColumns({"__q": token_runs(query), "__e": token_runs(evidence), "__nq": F.size(query), "__ne": F.size(evidence)})
    own = own.withColumn("__m", merged(F.col("__q"), F.col("__e")))
    own = own.withColumns({"__shared": total(F.col("__m"), lambda x: F.least(x["a"], x["b"])), "__dot": total(F.col("__m"), lambda x: x["a"].cast("double") * x["b"])})
    some = (F.col("__nq") > 0) & (F.col("__ne") > 0)
    own = own.withColumns(
        {
            "recall": F.when(some, F.col("__shared") / F.col("__nq")).otherwise(0.0),
            "f1": F.when(some & (F.col("__shared") > 0), 2 * F.col("__shared") / (F.col("__nq") + F.col("__ne"))).otherwise(0.0),
            "cosine": F.when(some, F.col("__dot") / (norm(F.col("__q")) * norm(F.col("__e")))).otherwise(0.0),
        }
    )
    return own.drop("__q", "__e", "__m", "__shared", "__dot", "__nq", "__ne")


def child_candidates(qa: DataFrame, children: DataFrame, limit: int | None = 5) -> DataFrame:
    """(qa_id, rank, child_id, score, citation_score, recall, f1, cosine) of the best children of each record's parent.

    qa: qa_id, parent_id, question, answer, citation; children: child_id, parent_id, sequence, text, canonical_citation.
    """
    query = content_tokens(F.concat(F.coalesce("answer", F.lit("")), F.lit(" "), F.coalesce("question", F.lit(""))))
    children = children.join(qa.select("parent_id").distinct(), "parent_id", "left_semi")  # no other parent's children are read
    pairs = qa.select("qa_id", "parent_id", F.coalesce("citation", F.lit("")).alias("gold"), query.alias("q")).join(
        children.select("child_id", "parent_id", "sequence", F.coalesce("canonical_citation", F.lit("")).alias("own"), content_tokens(F.col("text")).alias("e")), "parent_id"
    )
    scored = overlap(pairs, F.col("q"), F.col("e")).withColumn("citation_score", citation_score(F.col("gold"), F.col("own")))
    score = 0.45 * F.col("recall") + 0.2 * F.col("f1") + 0.2 * F.col("cosine") + 0.15 * F.col("citation_score")
    ranked = top_k(scored.withColumn("score", F.round(score, 6)), ["qa_id"], [F.desc("score"), F.asc("sequence"), F.asc("child_id")], limit)
    return ranked.select("qa_id", "rank", "child_id", "score", "citation_score", *(F.round(c, 6).alias(c) for c in ("recall", "f1", "cosine")))


def review_priority(qa: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qa_id, margin, priority) of every record, from the ranked candidates."""
    after = F.lead("score").over(Window.partitionBy("qa_id").orderBy("rank"))
    top = candidates.withColumn("margin", F.round(F.col("score") - F.coalesce(after, F.lit(0.0)), 6)).where("rank = 1")
    level = (
        F.when(F.col("score").isNull(), "blocking")
        .when((F.col("citation_score") == 1.0) & (F.col("recall") >= 0.45), "low")
        .when((F.col("recall") >= 0.55) & (F.col("margin") >= 0.08), "medium")
        .otherwise("high")
    )
    return qa.select("qa_id").join(top, "qa_id", "left").select("qa_id", "margin", level.alias("priority"))


#: Entries of the chunk side that may be broadcast, 16 bytes each.
MAX_ENTRIES = 1_000_000


def containment(chunks: DataFrame, parents: DataFrame, size: int = 5) -> DataFrame:
    """(chunk_id, parent_id, equal, within, contains) of all pairs where one normal text holds the other.

    chunks: chunk_id, text; parents: parent_id, text. A held text's inner words are whole words of the text that holds it,
    so a held text is sought by the hash of its second to (size + 1)th word (without its last) among the holder's windows of
    the lengths that occur. Held texts of one or two words meet the parts of words, of the lengths that occur among them.
    Each side is read once for its lengths and once for its entries; pairs that meet are compared in full.
    """

    def side(df, key):
        words = lexical_tokens(F.col("text"))
        return df.select(F.col(key), words.alias("w"))  # a filter here would have Spark tokenise twice

    w = F.col("w")
    inner = F.least(F.lit(size), F.size(w) - 2)

    def shapes(df):
        """Lengths of heads, lengths of the words of short texts, and words in all: size + word lengths squared values at most."""
        short_ = F.when(F.size(w).between(1, 2), F.concat(F.array(F.length(w[0])), F.when(F.size(w) == 2, F.array(F.length(F.get(w, F.lit(1))))).otherwise(F.array().cast("array<int>"))))
        row = df.agg(F.collect_set(F.when(F.size(w) > 2, inner)), F.collect_set(short_), F.coalesce(F.sum(F.size(w)), F.lit(0))).first()
        return sorted(row[0]), sorted(tuple(x) for x in row[1]), row[2]

    def held(tag):
        """The entry of a text as one that is held."""
        head = F.xxhash64(F.lit(tag), F.slice(w, F.lit(2), F.greatest(inner, F.lit(0))))
        return F.array(F.when(F.size(w) > 2, head).otherwise(F.xxhash64(F.lit(tag), F.array_join(w, " "))))

    def holder(tag, lengths, short_):
        """The entries of a text as one that holds."""

        def windows(n):
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.xxhash64(F.lit(tag), F.slice(w, i, n)))

        def parts(n):
            """Where a held text of one or two words may lie: the first may begin, and the last end, inside a word."""
            if len(n) == 1:
                inside = F.transform(F.filter(w, lambda x: F.length(x) >= n[0]), lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - (n[0] - 1)), lambda i: F.substring(x, i, F.lit(n[0]))))
                found = F.flatten(inside)
            else:
                pairs = F.transform(w, lambda x, i: F.when((F.length(x) >= n[0]) & (F.length(F.get(w, i + 1)) >= n[1]), F.concat(F.right(x, F.lit(n[0])), F.lit(" "), F.left(F.get(w, i + 1), F.lit(n[1])))))
                found = F.filter(pairs, lambda x: x.isNotNull())
            return F.transform(found, lambda x: F.xxhash64(F.lit(tag), x))

        return [*map(windows, lengths), *map(parts, short_)]

    c, p = side(chunks, "chunk_id"), side(parents, "parent_id")
    (c_lengths, c_short, c_words), (p_lengths, p_short, _) = shapes(c), shapes(p)
    entries = lambda *lists: F.explode(F.when(F.size(w) > 0, F.array_distinct(F.concat(*lists)))).alias("entry")
    ec = c.select("chunk_id", entries(held("c"), *holder("p", p_lengths, p_short)))
    ep = p.select("parent_id", entries(held("p"), *holder("c", c_lengths, c_short)))
    if c_words * (1 + len(p_lengths) + 8 * len(p_short)) <= MAX_ENTRIES:
        ec = F.broadcast(ec)
    likely = materialized(ep.join(ec, "entry").select("chunk_id", "parent_id").distinct(), "likely")
    text = lambda df, key, name: side(df.join(likely.select(key).distinct(), key, "left_semi"), key).select(key, F.array_join("w", " ").alias(name))  # noqa: E731  (no other text is read)
    pairs = likely.join(text(chunks, "chunk_id", "c"), "chunk_id").join(text(parents, "parent_id", "p"), "parent_id")
    flags = pairs.select("chunk_id", "parent_id", (F.col("c") == F.col("p")).alias("equal"), F.contains("p", "c").alias("within"), F.contains("c", "p").alias("contains"))
    return flags.where("equal OR within OR contains")


#: How cosine and coverage make a score.
COSINE, COVERAGE = 0.3, 0.7


def similar(chunks: DataFrame, parents: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(chunk_id, parent_id, cosine, coverage, score) of the least most alike parents of every chunk, and of all pairs wanted (chunk_id, parent_id); parents without shared tokens are left out.

    Both parts of a score are sums over shared tokens that grow with the counts, so a chunk's tokens are read from the one
    that can add most, and parents that have only the others are left out as soon as these together stay below the
    least-th score found.
    """
    own = chunks.select("chunk_id", lexical_tokens(F.coalesce("text", F.lit(""))).alias("t")).select("chunk_id", F.size("t").alias("n"), token_runs(F.col("t")).alias("runs"))
    norm = F.sqrt(F.aggregate("runs", F.lit(0.0), lambda a, x: a + x["f"].cast("double") * x["f"]))
    asked = materialized(own.select("chunk_id", "n", norm.alias("norm"), F.inline("runs")), "asked")
    whole = index(parents, "parent_id").withColumn("norm", norm)
    held, terms = postings(asked, whole, "norm")
    numbered = lambda df, *names: df.join(terms, "term").select(*names, F.col("number").alias("term"), "df", (F.col("f") / F.col("norm")).alias("unit"), F.col("f").cast("double").alias("f"))
    questions = materialized(numbered(asked, F.col("chunk_id").alias("q"), "n").select("q", "term", F.col("unit").alias("own_unit"), F.col("f").alias("own_f"), "n", "df"), "questions")
    documents = numbered(held, "id").select("id", "term", "unit", "f")
    parts = {"cosine": F.col("own_unit") * F.col("unit"), "coverage": F.least("own_f", "f") / F.col("n")}
    score = F.round(COSINE * F.col("cosine") + COVERAGE * F.col("coverage"), 8)

    def gain(w, v):
        return np.stack([w[0] * v[0], np.minimum(w[1], v[1]) / w[2]])

    barred = materialized(with_bars(questions, documents, COSINE * parts["cosine"] + COVERAGE * parts["coverage"], "unit", least), "barred")
    found = cells.top_by_terms(barred, documents, held.count(), gain, [COSINE, COVERAGE], least, list(parts), down=True)
    best = found.select(F.col("q").alias("chunk_id"), F.col("id").alias("parent_id"), *parts, score.alias("score"))
    best = top_k(best, ["chunk_id"], alike_order(), least).drop("rank")
    pairs = wanted.select(F.col("chunk_id").alias("q"), F.col("parent_id").alias("id")).distinct()
    named = documents.join(pairs, "id").join(questions, ["q", "term"]).groupBy("q", "id").agg(*(F.round(F.sum(x), 10).alias(c) for c, x in parts.items()))
    named = named.select(F.col("q").alias("chunk_id"), F.col("id").alias("parent_id"), *parts, score.alias("score"))
    best = materialized(best, "alike")
    return best.unionByName(named.join(best, ["chunk_id", "parent_id"], "left_anti"))


def alike_order() -> list[Column]:
    """The order of the parents of a chunk."""
    return [F.desc(c) for c in ("score", "cosine", "coverage", "parent_id")]


def lineage(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """(chunk_id, status, method, parent_id, match_score, cosine, coverage, margin, candidates) of every chunk.

    A parent that alone equals, holds or is held by the chunk is taken, in this order; otherwise the most alike one, for
    review. Alike: 0.3 cosine + 0.7 coverage over shared tokens; parents without shared tokens score 0.
    """
    hits = containment(chunks, parents)
    names = (("equal", "normalized_equal"), ("within", "chunk_in_parent"), ("contains", "parent_in_chunk"))
    one = hits.groupBy("chunk_id").agg(*(F.count_if(c).alias(f"n_{c}") for c, _ in names), *(F.min(F.when(F.col(c), F.col("parent_id"))).alias(c) for c, _ in names))
    taken = F.coalesce(*(F.when(F.col(f"n_{c}") == 1, F.col(c)) for c, _ in names))
    method = F.coalesce(*(F.when(F.col(f"n_{c}") == 1, F.lit(m)) for c, m in names))
    chosen = materialized(one.select("chunk_id", taken.alias("taken"), method.alias("method")).where("taken IS NOT NULL"), "taken")

    alike = similar(chunks, parents, chosen.select("chunk_id", F.col("taken").alias("parent_id")), 5)
    ranked = top_k(alike, ["chunk_id"], alike_order(), None)
    best = ranked.where("rank <= 5").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("rank", "parent_id", "score", "cosine", "coverage"))).alias("best"))
    own = ranked.join(chosen, "chunk_id").where("parent_id = taken").select("chunk_id", F.struct("score", "cosine", "coverage").alias("own"))
    out = chunks.select("chunk_id").join(best, "chunk_id", "left").join(chosen, "chunk_id", "left").join(own, "chunk_id", "left")
    parent = F.coalesce("taken", F.get("best", F.lit(0))["parent_id"])
    mine = F.coalesce("own", F.struct(*(F.get("best", F.lit(0))[c].alias(c) for c in ("score", "cosine", "coverage"))))
    other = F.filter("best", lambda x: x["parent_id"] != parent)
    return out.select(
        "chunk_id",
        F.when(F.col("taken").isNull(), "review_required").otherwise("auto_mapped").alias("status"),
        F.coalesce("method", F.lit("fuzzy_review")).alias("method"),
        parent.alias("parent_id"),
        *(F.round(F.coalesce(mine[c], F.lit(0.0)), 6).alias(n) for c, n in (("score", "match_score"), ("cosine", "cosine"), ("coverage", "coverage"))),
        F.round(F.coalesce(mine["score"], F.lit(0.0)) - F.coalesce(F.get(other, F.lit(0))["score"], F.lit(0.0)), 6).alias("margin"),
        F.array_join(F.transform("best", lambda x: x["parent_id"].cast("string")), ";").alias("candidates"),
    )


def proposed_evidence(qa: DataFrame, children: DataFrame, least: float = 0.12, limit: int = 6) -> DataFrame:
    """(qa_id, child_ids): the best child for the whole answer, for each of its sentences (score at least least), and every child of the very citation; first mentions, limit at most."""
    whole = materialized(child_candidates(qa, children, None), "candidates")
    first = whole.where("rank = 1").select("qa_id", F.lit(0).alias("o"), F.lit(0).alias("i"), "child_id")
    parts = qa.select("qa_id", "parent_id", "citation", F.posexplode(sentences(F.col("answer"))).alias("i", "answer"))
    parts = parts.select(F.struct("qa_id", "i").alias("qa_id"), "parent_id", "citation", "answer", F.lit("").alias("question"))
    each = child_candidates(parts, children, 1).where(F.col("score") >= least).select("qa_id.qa_id", F.lit(1).alias("o"), "qa_id.i", "child_id")
    cited = whole.where("citation_score = 1.0").select("qa_id", F.lit(2).alias("o"), F.col("rank").alias("i"), "child_id")
    rows = first.unionByName(each).unionByName(cited).groupBy("qa_id", "child_id").agg(F.min(F.struct("o", "i")).alias("at"))
    listed = rows.groupBy("qa_id").agg(F.array_sort(F.collect_list(F.struct("at", "child_id"))).alias("l"))
    return listed.select("qa_id", F.slice(F.transform("l", lambda x: x["child_id"]), 1, limit).alias("child_ids"))
