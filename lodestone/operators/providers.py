"""Sources of vectors, pair scores and answers: any function over a list of requests, asked in batches on the executors, and offline ones.

A provider of vectors gives (index, vector) pairs in any order; one of scores a float for each (question, passage); one
of answers a JSON payload for each JSON request. The offline ones are deterministic and need no model.
"""

from __future__ import annotations

import json
import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

TOKEN = re.compile("[a-z0-9]+")
Vectors = Callable[[list[str]], Iterable[tuple[int, list[float]]]]
Scores = Callable[[list[tuple[str, str]]], list[float]]


def hashed_vectors(size: int = 64) -> Vectors:
    """Token counts hashed to size signed buckets, at length one (all zero without tokens)."""

    def embed(texts: list[str]):
        for i, text in enumerate(texts):
            v = [0.0] * size
            hashes = [zlib.crc32(token.encode()) for token in TOKEN.findall(text.lower())]
            for h in hashes:
                v[h % size] += 1.0 if h >> 31 else -1.0
            if not any(v):  # tokens that cancel each other out count without signs
                for h in hashes:
                    v[h % size] += 1.0
            norm = math.sqrt(math.fsum(x * x for x in v))
            yield i, [x / norm for x in v] if norm else v

    return embed


def lexical_scores(pairs: list[tuple[str, str]]) -> list[float]:
    """The share of all distinct tokens of question and passage that both have."""
    out = []
    for question, passage in pairs:
        a, b = set(TOKEN.findall(question.lower())), set(TOKEN.findall(passage.lower()))
        out.append(len(a & b) / len(a | b) if a | b else 0.0)
    return out


def extracted_answers(requests: list[str], claims: int = 2) -> list[str]:
    """For each {"question", "sources": [{"source_id", "text"}]} the payload that quotes the sentences most like the question, one claim each; it abstains without any shared token."""
    out = []
    for request in requests:
        asked = json.loads(request)
        sentences = [(s["source_id"], x.strip()) for s in asked["sources"] for x in re.split(r"(?<=[.!?])\s+|\n", s["text"]) if x.strip()]
        scored = sorted(zip(lexical_scores([(asked["question"], x) for _, x in sentences]), range(len(sentences))), key=lambda y: (-y[0], y[1]))
        best = [sentences[i] for score, i in scored[:claims] if score > 0]
        said = [{"claim_id": f"c{n}", "text": x, "supports": [{"source_id": s, "quote": x}]} for n, (s, x) in enumerate(best, 1)]
        out.append(json.dumps({"answer_text": " ".join(x for _, x in best) or "No source answers this.", "abstain": not best, "abstention_reason": None if best else "insufficient_evidence", "claims": said}, ensure_ascii=False))
    return out


def completed(prompts: list[str]) -> list[str]:
    """For each prompt that ends with a question, the sentence or example answer before it that is most like the question; the first of equals, and nothing without a shared token."""
    out = []
    for prompt in prompts:
        before, _, question = prompt.rpartition("Question:")
        question = question.removesuffix("Answer:").strip()
        said = [x.strip() for x in re.split(r"(?<=[.!?])\s+|\n", before) if x.strip() and not x.startswith("Question:")]
        scores = lexical_scores([(question, x) for x in said])
        best = max(range(len(said)), key=lambda i: (scores[i], -i), default=None)
        out.append(said[best].removeprefix("Answer:").strip() if best is not None and scores[best] else "")
    return out


def embedded(rows: DataFrame, provider: Vectors, text: str = "text", batch: int = 64) -> DataFrame:
    """rows with embedding, the provider's vector of each text (null: empty), whatever the order in which it answers. ValueError for a missing or second answer."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, out = [t or "" for t in b.column(text).to_pylist()], []
            for at in range(0, len(texts), batch):
                asked = texts[at : at + batch]
                answers = list(provider(asked))
                placed = dict(answers)
                if len(answers) != len(asked) or placed.keys() != set(range(len(asked))):
                    raise ValueError("the provider must answer every text once")
                out += [placed[i] for i in range(len(asked))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], [*b.schema.names, "embedding"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


def vector_metadata(rows: DataFrame, model: str, key: str = "id", text: str = "text") -> dict:
    """What a cache must match: model, number of rows, and digests of ids and of ids with texts, in no order."""
    digest = lambda *c: F.coalesce(F.sum(F.xxhash64(*c).cast("decimal(38,0)")), F.lit(0)).cast("string")
    n, ids, texts = rows.agg(F.count(F.lit(1)), digest(key), digest(key, text)).first()
    return {"model": model, "count": n, "ids": ids, "texts": texts}


#: Snapshots of a cache that stay: the current one, and one that readers may still read.
SNAPSHOTS_KEPT = 2


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _published(spark: SparkSession, path: str) -> list[str]:
    """The names number-snapshot that were published, in their order."""
    fs, at = _folder(spark, f"{path}/published")
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def _publish(spark: SparkSession, path: str, snapshot: str) -> None:
    """Makes a whole snapshot the current one: the name of an empty file says all, so it is there or not. Older ones go."""
    before = _published(spark, path)
    fs, at = _folder(spark, f"{path}/published/{int(before[-1].split('-')[0]) + 1 if before else 1:09d}-{snapshot}")
    if not fs.createNewFile(at):
        raise ValueError(f"{at} exists")
    for name in _published(spark, path)[:-SNAPSHOTS_KEPT]:
        for old in (f"{path}/published/{name}", f"{path}/snapshots/{name.partition('-')[2]}"):
            fs, at = _folder(spark, old)
            fs.delete(at, True)


def _read_cache(spark: SparkSession, path: str) -> tuple[dict | None, DataFrame | None]:
    names = _published(spark, path)
    if not names:
        return None, None
    at = f"{path}/snapshots/{names[-1].partition('-')[2]}"
    return json.loads(spark.read.text(f"{at}/metadata").first()[0]), spark.read.parquet(f"{at}/vectors")


def cached_vectors(rows: DataFrame, path: str, model: str, provider: Vectors, key: str = "id", text: str = "text", batch: int = 64) -> tuple[DataFrame, bool]:
    """((key, embedding, cached), whether the cache at path matched as it was).

    A cache with the same metadata is read as it is. Otherwise vectors of the same model and text are taken over, the
    provider is asked for each other text once, and a new snapshot of vectors and metadata is written and then published,
    so that whoever reads meanwhile, or after a crash, has the old one whole.
    """
    spark, wanted = rows.sparkSession, vector_metadata(rows, model, key, text)
    held, old = _read_cache(spark, path)
    if held == wanted:
        return old.select(key, "embedding", F.lit(True).alias("cached")), True
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    own = rows.select(key, text, digest.alias("__digest"))
    known = old.select(F.col("digest").alias("__digest"), "embedding").dropDuplicates(["__digest"]) if held and held["model"] == model else None
    lacking = own if known is None else own.join(known, "__digest", "left_anti")
    new = embedded(lacking.groupBy("__digest").agg(F.min(text).alias(text)), provider, text, batch).select("__digest", "embedding", F.lit(False).alias("cached"))
    vectors = new if known is None else known.withColumn("cached", F.lit(True)).unionByName(new)
    snapshot = uuid.uuid4().hex
    at = f"{path}/snapshots/{snapshot}"
    own.join(vectors, "__digest").select(key, F.col("__digest").alias("digest"), "embedding", "cached").write.parquet(f"{at}/vectors")
    spark.createDataFrame([(json.dumps(wanted, sort_keys=True),)], "value string").coalesce(1).write.text(f"{at}/metadata")
    _publish(spark, path, snapshot)
    return spark.read.parquet(f"{at}/vectors").select(key, "embedding", "cached"), False


def scored_pairs(pairs: DataFrame, provider: Scores, question: str = "question", passage: str = "text", batch: int = 32) -> DataFrame:
    """pairs with score, the provider's score of each (question, passage); nulls are empty. ValueError if it does not answer all."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            asked = [(q or "", p or "") for q, p in zip(b.column(question).to_pylist(), b.column(passage).to_pylist())]
            out = [x for at in range(0, len(asked), batch) for x in provider(asked[at : at + batch])]
            if len(out) != len(asked):
                raise ValueError("the provider must score every pair")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "score"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("score", DoubleType())]))


def cached_scores(pairs: DataFrame, folder: str, model: str, provider: Scores, question: str = "question", passage: str = "text", commit: int = 10_000, batch: int = 32) -> DataFrame:
    """pairs with score and cached, like scored_pairs, with the scores kept under folder by model, question and passage: no pair of texts is asked twice, and a lost run asks only for the rest."""
    from lodestone.operators.baselines import cache_key, through_folder

    key = cache_key(model, F.coalesce(F.col(question), F.lit("")), F.coalesce(F.col(passage), F.lit("")))
    request = F.to_json(F.struct(F.coalesce(F.col(question), F.lit("")).alias("q"), F.coalesce(F.col(passage), F.lit("")).alias("p")))
    own = pairs.withColumn("__key", key)

    def ask(requests: list[str]) -> list[str]:
        found = provider([(x["q"], x["p"]) for x in map(json.loads, requests)])
        if len(found) != len(requests):
            raise ValueError("the provider must score every pair")
        return [repr(float(x)) for x in found]

    asked = own.select(F.col("__key").alias("key"), request.alias("request")).dropDuplicates(["key"])
    said = through_folder(asked, folder, ask, commit, batch)
    return own.join(said, own["__key"] == said["key"]).withColumn("score", F.col("response").cast("double")).drop("__key", "key", "response")
