"""Whole flows over operators: the retrieval ladder, the generation of answers, and the freezing of a reviewed benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import answers, baselines, context, providers, retrieval, review, splits
from lodestone.operators.relational import require_empty
from lodestone.sources.shared import materialized


def stage(spark, folder: str | None, name: str, build) -> DataFrame:
    """The table name under folder if it was finished before, else build(), written there; without a folder, in the shared one."""
    if folder is None:
        return materialized(build(), name)
    at = f"{folder}/{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def ladder(
    questions: DataFrame, children: DataFrame, query_vectors: DataFrame, child_vectors: DataFrame, limit: int = 20, constant: float = 60, scores: providers.Scores | None = None, folder: str | None = None, **contexts
) -> dict[str, DataFrame]:
    """Rankings (qa_id, id, score, rank) by name: bm25, dense, hybrid, their fusion, and with scores also reranked; and if children have parent_id, sequence and word_count, contexts of the last of them.

    questions: qa_id, question; children: id, text; vectors: qa_id or id, embedding; scores: a provider of pair scores;
    contexts: options of context_bundles. With folder, each stage is kept there, and one that is there is not run again.
    """
    spark, out = questions.sparkSession, {}
    out["bm25"] = stage(spark, folder, "bm25", lambda: retrieval.bm25(questions, children, limit))
    near = lambda: retrieval.cosine_top_k(query_vectors, child_vectors, limit, "qa_id", "id").withColumnRenamed("q", "qa_id").select("qa_id", "id", "score", "rank")
    out["dense"] = stage(spark, folder, "dense", near)
    both = out["bm25"].select(F.lit("bm25").alias("ranker"), F.lit(1.0).alias("weight"), "qa_id", "id", "rank").union(out["dense"].select(F.lit("dense"), F.lit(1.0), "qa_id", "id", "rank"))
    last = out["hybrid"] = stage(spark, folder, "hybrid", lambda: retrieval.reciprocal_rank_fusion(both, constant, limit))
    if scores is not None:
        pairs = last.select("qa_id", "id", F.col("rank").alias("original_rank")).join(questions.select("qa_id", "question"), "qa_id").join(children.select("id", "text"), "id")
        asked = lambda: providers.scored_pairs(pairs, scores) if folder is None else providers.cached_scores(pairs, f"{folder}/scores", getattr(scores, "__name__", "scores"), scores)
        scored = lambda: asked().select("qa_id", "id", "original_rank", F.round("score", 6).alias("score"))
        last = out["reranked"] = stage(spark, folder, "reranked", lambda: retrieval.rerank(scored(), limit))
    if {"parent_id", "sequence", "word_count"} <= set(children.columns):
        kids = children.select(F.col("id").alias("child_id"), "parent_id", "sequence", "word_count")
        out["contexts"] = stage(spark, folder, "contexts", lambda: context.context_bundles(last.select("qa_id", "rank", F.col("id").alias("child_id")), kids, **contexts))
    return out


def generate(questions: DataFrame, sources: DataFrame, provider, cache: DataFrame | str, model: str = "extract", system: str = "", schema: str = "") -> dict[str, DataFrame]:
    """answers (qa_id, key, payload text, cached), reports of their verification, citations of the accepted ones, and a summary row.

    questions: qa_id, question; sources: qa_id, position, source_id, text and what answers.verify needs of evidence;
    cache: key, response, or a folder that takes up answers group by group, so that a lost run asks only for the rest; provider: requests (JSON with question and sources) to payloads. A question without sources is asked without any.
    """
    given = sources.groupBy("qa_id").agg(F.array_sort(F.collect_list(F.struct("position", "source_id", "text"))).alias("l"))
    listed = F.coalesce(F.transform("l", lambda x: F.struct(x["source_id"].alias("source_id"), x["text"].alias("text"))), F.array().cast("array<struct<source_id:string,text:string>>"))
    request = F.to_json(F.struct(F.col("question").alias("question"), listed.alias("sources")))
    asked = materialized(questions.join(given, "qa_id", "left").select("qa_id", request.alias("request")).withColumn("key", baselines.cache_key(model, F.lit(system), F.col("request"), schema)), "requests")
    through = baselines.through_folder if isinstance(cache, str) else baselines.through_cache
    said = through(asked.select("key", "request").distinct(), cache, provider)
    made = materialized(asked.select("qa_id", "key").join(said, "key").select("qa_id", "key", F.col("response").alias("payload"), "cached"), "answers")
    parsed = made.select("qa_id", F.try_parse_json("payload").alias("payload"))
    reports = materialized(answers.verify(parsed, sources), "reports")
    accepted = reports.where("decision = 'accept_structurally'").select("qa_id")
    cited = answers.resolve_citations(parsed.join(accepted, "qa_id", "left_semi"), sources)
    return {"answers": made, "reports": reports, "citations": cited, "summary": answers.generation_summary(reports)}


#: What a question is asked with, by system.
TEMPLATE = "Sources:\n{sources}\n\nQuestion: {question}\nAnswer:"
SYSTEMS = ("fewshot", "rag", "local")


def rerun(questions: DataFrame, given: DataFrame, system: str, k: int, provider, folder: str, model: str = "completed", template: str = TEMPLATE, seed: str = "lodestone-v1") -> DataFrame:
    """Predictions of a baseline, as rescore takes them: result_id, system, variant, qa_id, question, prediction, retrieved_chunks; and cached.

    system: fewshot (given: examples qa_id, question, answer, of which each question gets k of its own, never itself), rag
    (given: chunks id, citation, text, of which the k best by BM25 are quoted) or local (the question alone; given is not
    read). provider: prompts to answers. Answers are kept under folder by model and prompt; a lost run asks only for the rest.
    """
    if system not in SYSTEMS:
        raise ValueError(f"system must be one of {SYSTEMS}")
    own = questions.select("qa_id", "question").dropDuplicates(["qa_id"])
    chunks = F.lit(None).cast("array<string>")
    if system == "fewshot":
        shots = splits.exemplars(own, given, k, seed).join(given.select(F.col("qa_id").alias("exemplar"), "question", "answer"), "exemplar")
        asked = baselines.few_shot_prompt(shots, own.withColumnRenamed("qa_id", "q")).withColumnRenamed("q", "qa_id").withColumn("retrieved_chunks", chunks)
    elif system == "rag":
        ranked = materialized(retrieval.bm25(own, given, k).join(given.select("id", F.coalesce("citation", F.lit("")).alias("citation"), "text"), "id"), "quoted")
        quoted = baselines.excerpts(ranked.withColumnRenamed("qa_id", "q"))
        found = ranked.groupBy("qa_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))), lambda x: x["id"]).alias("retrieved_chunks"))
        asked = own.join(quoted, own["qa_id"] == quoted["q"]).join(found, "qa_id").select("qa_id", baselines.user_message(template, F.col("question"), F.col("excerpts")).alias("prompt"), "retrieved_chunks")
    else:
        asked = own.select("qa_id", F.concat(F.lit("Question: "), "question", F.lit("\nAnswer:")).alias("prompt"), chunks.alias("retrieved_chunks"))
    asked = materialized(asked.withColumn("key", baselines.cache_key(model, F.lit(system), F.col("prompt"))), "prompts")
    said = baselines.through_folder(asked.select("key", F.col("prompt").alias("request")).dropDuplicates(["key"]), folder, provider)
    made = asked.join(said, "key").join(own, "qa_id")
    name = F.concat_ws("-", F.lit(system), F.lit(str(k)), F.col("qa_id").cast("string"))
    return made.select(name.alias("result_id"), F.lit(system).alias("system"), F.lit(str(k)).alias("variant"), "qa_id", "question", F.col("response").alias("prediction"), "retrieved_chunks", "cached")


def metrics(qa: DataFrame, rankings: dict[str, DataFrame], parents: DataFrame, ks: list[int]) -> DataFrame:
    """retrieval.evaluate of every ranking, with its name."""
    out = None
    for name, ranked in rankings.items():
        own = retrieval.evaluate(qa, ranked, parents, ks).withColumn("ranker", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def freeze(candidates: DataFrame, reviews: DataFrame, children: DataFrame, expected: DataFrame | None = None, inherit: DataFrame | None = None, fraction: float = 0.4, seed: str = "lodestone-v1") -> DataFrame:
    """The reviewed benchmark with its split, inherited from a manifest (qa_id, split) or made anew. ValueError if reviews have errors or a group leaks."""
    require_empty(review.review_errors(reviews, candidates, children, expected), "reviews cannot be frozen")
    retained = materialized(review.apply_decisions(candidates, reviews, children), "retained")
    require_empty(retained.where(F.size("acceptable_evidence_sets") == 0).select("qa_id"), "records without evidence")
    assigned = splits.inherited_split(retained, inherit) if inherit is not None else splits.grouped_split(retained, "parent_id", fraction, seed)
    assigned = materialized(assigned, "frozen")
    require_empty(splits.leaks(assigned), "groups in more than one split")
    return assigned
