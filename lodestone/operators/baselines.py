"""Rescoring of stored predictions, prompts, and provider calls behind a response cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.python_text import rouge_l
from lodestone.functions.text import has_citation, legacy_citation_match, normalise_question
from lodestone.operators import citations
from lodestone.sources.shared import materialized

#: Content and citation scores from which a prediction counts as right by the older measure.
CONTENT_FLOOR, CITATION_FLOOR = 0.3, 0.5


def comparable(results: DataFrame, benchmark: DataFrame) -> DataFrame:
    """results (qa_id, question, ...) joined with their benchmark record, without those it lacks or whose question was reworded."""
    gold = benchmark.withColumnRenamed("question", "__question")
    return results.join(gold, "qa_id").where(normalise_question(F.col("question")) == normalise_question(F.col("__question"))).drop("__question")


def rescore(results: DataFrame, benchmark: DataFrame, parents: DataFrame, chunk_parent: DataFrame | None = None) -> DataFrame:
    """A row of scores for every comparable result.

    results: result_id, system, variant, qa_id, question, prediction, retrieved_chunks array; benchmark: qa_id, split,
    question, reference_answer, acceptable_citation, acceptable_parent_ids; chunk_parent: chunk_id, parent_id.
    Undefined scores are null, so that means leave them out.
    """
    own = comparable(results, benchmark)
    matched = citations.matches(own.select(F.col("result_id").alias("id"), F.coalesce("prediction", F.lit("")).alias("prediction"), F.col("acceptable_citation").alias("gold")), parents)
    scored = own.join(matched.withColumnRenamed("id", "result_id"), "result_id")
    if chunk_parent is not None:
        hits = own.select("result_id", F.explode("retrieved_chunks").alias("chunk_id")).join(chunk_parent, "chunk_id").groupBy("result_id").agg(F.collect_set("parent_id").alias("hits"))
        scored = scored.join(hits, "result_id", "left")
    else:
        scored = scored.withColumn("hits", F.lit(None).cast("array<string>"))
    said = F.coalesce("prediction", F.lit(""))
    content, loose = rouge_l(said, F.col("reference_answer")), legacy_citation_match(said, F.col("acceptable_citation"))
    scored = scored.withColumn("rouge_l", content)
    return scored.select(
        "result_id",
        "system",
        "variant",
        "qa_id",
        "split",
        "rouge_l",
        has_citation(said).alias("has_citation"),
        loose.alias("legacy_citation_match"),
        ((loose >= CITATION_FLOOR) & (F.col("rouge_l") >= CONTENT_FLOOR)).cast("int").alias("legacy_correct"),
        F.col("parent").cast("int").alias("parent_citation_correct"),
        F.col("exact").cast("int").alias("exact_citation_correct"),
        F.when(F.col("parent").isNotNull(), (F.col("parent") & (F.col("rouge_l") >= CONTENT_FLOOR)).cast("int")).alias("grounded"),
        F.when(F.col("retrieved_chunks").isNotNull(), F.coalesce(F.arrays_overlap("hits", "acceptable_parent_ids"), F.lit(False)).cast("int")).alias("retrieval_parent_hit"),
    )


MEANS = ("rouge_l", "has_citation", "legacy_correct", "parent_citation_correct", "exact_citation_correct", "grounded", "retrieval_parent_hit")


def aggregate(scored: DataFrame, means: tuple[str, ...] = MEANS, keys: tuple[str, ...] = ("system", "variant")) -> DataFrame:
    """Means (4 digits) and numbers of defined values for each of keys, over all splits (split null) and for each split."""
    k = [F.col(c) for c in keys]
    split = F.col("split")
    return scored.groupingSets([k, [*k, split]], *k, split).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in means), *(F.count(c).alias(f"{c}_n") for c in means))


def variant_of(variant: Column, k_shots: Column, k: Column) -> Column:
    return F.coalesce(variant.cast("string"), k_shots.cast("string"), k.cast("string"), F.lit("?"))


def system_of(system: Column, path: Column, names: tuple[str, ...] = ("fewshot", "rag", "lora")) -> Column:
    """The declared system, or else the first of names in the file's stem, or else the stem."""
    stem = F.lower(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1))
    return F.coalesce(F.nullif(system, F.lit("")), *(F.when(F.contains(stem, F.lit(n)), F.lit(n)) for n in names), stem)


def reproducibility(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, rate): equal normal forms among rows that have both."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((normalise_question(F.col(a)) == normalise_question(F.col(b))).cast("double")), 4).alias("rate"))


def user_message(template: str, question: Column, sources: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{question}"), question), F.lit("{sources}"), sources)


def few_shot_prompt(shots: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, prompt) of shots (q, rank, question, answer) and queries (q, question)."""
    block = F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), "answer")
    listed = shots.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["b"]), "\n\n")
    return queries.join(listed, "q", "left").select("q", F.concat_ws("\n\n", body, F.concat(F.lit("Question: "), "question", F.lit("\nAnswer:"))).alias("prompt"))


def excerpts(retrieved: DataFrame, limit: int = 1500) -> DataFrame:
    """(q, excerpts) of retrieved (q, rank, citation, text): numbered excerpts, limit characters of each."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "citation", F.lit("\n"), F.left("text", F.lit(limit)))
    listed = retrieved.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("l"))
    return listed.select("q", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("excerpts"))


def cache_key(model: str, system: Column, user: Column, schema: str = "") -> Column:
    return F.upper(F.sha2(F.concat(F.lit(model), F.lit("\0"), system, F.lit("\0"), user, F.lit("\0"), F.lit(schema)), 256))


def through_cache(requests: DataFrame, cache: DataFrame, provider: Callable[[list[str]], list[str]], batch: int = 64) -> DataFrame:
    """(key, response, cached) of every request (key, request): from cache (key, response) where it has the key, else from provider, asked in batches on the executors, once for each key."""
    hits = requests.join(cache, "key").select("key", "response", F.lit(True).alias("cached"))
    misses = requests.join(cache, "key", "left_anti").groupBy("key").agg(F.min("request").alias("request"))

    def ask(batches):
        import pyarrow as pa

        for rows in batches:
            texts = rows.column(1).to_pylist()
            said = [r for i in range(0, len(texts), batch) for r in provider(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(said, pa.string())], ["key", "response"])

    new = misses.select("key", "request").mapInArrow(ask, "key string, response string")
    asked = requests.select("key").join(new, "key").select("key", "response", F.lit(False).alias("cached"))
    return hits.union(asked)


def through_folder(requests: DataFrame, folder: str, provider: Callable[[list[str]], list[str]], commit: int = 10_000, batch: int = 64) -> DataFrame:
    """(key, response, cached) of every request (key, request), like through_cache, with the answers kept under folder.

    The keys that folder lacks are asked in groups of about commit, and each group's answers are added to the folder
    before the next is asked. So a run that is lost has lost one group at most, and the next one asks for the rest only.
    """
    spark = requests.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    empty = spark.createDataFrame([], "key string, response string")

    def held() -> DataFrame:
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        return spark.read.schema(empty.schema).parquet(folder) if there else empty

    before = materialized(held().select("key").distinct(), "answered")
    lacking = materialized(requests.join(before, "key", "left_anti").groupBy("key").agg(F.min("request").alias("request")), "lacking")
    n = -(-lacking.count() // commit)
    for i in range(n):
        own = lacking.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i)
        through_cache(own, empty, provider, batch).select("key", "response").write.mode("append").parquet(folder)
    said = held().groupBy("key").agg(F.min("response").alias("response"))
    known = before.withColumn("cached", F.lit(True))
    return requests.select("key").join(said, "key").join(known, "key", "left").select("key", "response", F.coalesce("cached", F.lit(False)).alias("cached"))


def first_billed(runs: DataFrame, model: str = "model", digest: str = "digest", order: str = "path") -> DataFrame:
    """runs with billed: whether a run is the first of its model and digest."""
    return runs.withColumn("billed", F.row_number().over(Window.partitionBy(model, digest).orderBy(order)) == 1)


def strict_schema(schema: object) -> object:
    """A JSON schema in the stricter dialect: no length keywords, alternatives as type lists, all properties required, none besides."""
    if isinstance(schema, list):
        return [strict_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: strict_schema(v) if k != "properties" else {n: strict_schema(p) for n, p in v.items()} for k, v in schema.items() if k not in ("minLength", "maxLength", "minItems", "maxItems", "uniqueItems", "$schema", "$id")}
    if "oneOf" in out:
        options = out.pop("oneOf")
        types = [o["type"] for o in options if "type" in o]
        values = [v for o in options for v in (o.get("enum") or ([o["const"]] if "const" in o else []))]
        if types:
            out["type"] = list(dict.fromkeys(types))
        if values:
            out["enum"] = values + [None] * ("null" in types and None not in values)
    if "properties" in out:
        out["additionalProperties"] = False
        out["required"] = list(out["properties"])
    return out
