"""Command lines: python -m lodestone COMMAND INPUT... OUTPUT. Inputs and outputs are JSON lines or CSV by name; an output that exists is not overwritten."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import answers, baselines, calibration, context, corpus, mapping, providers, retrieval, review, splits
from lodestone.plans import flows
from lodestone.sources import files, manifested, wordml
from lodestone.sources.shared import materialized, scratch


def _read(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        header = spark.read.option("header", True).csv(path).columns
        return files.read_csv_strings(spark, path, header)
    return spark.read.json(path)


def _write(rows: DataFrame, path: str) -> None:
    flat = all(not t.startswith(("array", "struct", "map")) for _, t in rows.dtypes)
    if path.endswith(".parquet"):
        rows.write.mode("errorifexists").parquet(path)
    elif path.endswith(".csv") and flat:
        files.write_csv(rows, path)
    else:
        files.write_jsonl(rows, path)


def _lineage(spark: SparkSession, inputs: list[str], output: str) -> None:
    """inputs' digests beside the output."""
    named = [files.file_digests(spark, x) for x in inputs]
    whole = named[0]
    for x in named[1:]:
        whole = whole.union(x)
    whole.coalesce(1).write.mode("errorifexists").json(f"{output}.lineage")


def _corpus(spark, a):
    parents, children, _ = corpus.build(wordml.read_blocks(spark, a.inputs[0]), a.version)
    issues = materialized(corpus.issues(parents, children), "issues")
    _write(parents, f"{a.output}/parents.jsonl")
    _write(children, f"{a.output}/children.jsonl")
    _write(issues, f"{a.output}/issues.csv")
    return 2 if issues.where("severity = 'critical'").limit(1).count() else 0


def _fuse(spark, a):
    ranked = [_read(spark, x).select(F.lit(x).alias("ranker"), F.lit(1.0).alias("weight"), "qa_id", "id", F.col("rank").cast("long")) for x in a.inputs]
    whole = ranked[0]
    for x in ranked[1:]:
        whole = whole.union(x)
    return retrieval.reciprocal_rank_fusion(whole, a.constant, a.limit)


def _rerank(spark, a):
    ranked, scores = (_read(spark, x) for x in a.inputs)
    return retrieval.rerank(ranked.select("qa_id", "id", F.col("rank").cast("long").alias("original_rank")).join(scores.select("qa_id", "id", F.col("score").cast("double")), ["qa_id", "id"]), a.limit)


def _verify(spark, a):
    said, evidence = (_read(spark, x) for x in a.inputs)
    return answers.verify(said.select("qa_id", F.try_parse_json("payload").alias("payload")), evidence)


def _freeze(spark, a):
    tables = [_read(spark, x) for x in a.inputs]
    return flows.freeze(*tables[:3], inherit=tables[3] if len(tables) > 3 else None, fraction=a.fraction, seed=a.seed)


def _embed(spark, a):
    return providers.cached_vectors(_read(spark, a.inputs[0]), f"{a.output}.cache", f"hashed-{a.size}", providers.hashed_vectors(a.size))[0].drop("cached")


def _ladder(spark, a):
    found = flows.ladder(*(_read(spark, x) for x in a.inputs[:4]), a.limit, a.constant, providers.lexical_scores, a.output)
    if len(a.inputs) > 5:
        ranked = {n: x for n, x in found.items() if n != "contexts"}
        _write(flows.metrics(_read(spark, a.inputs[4]), ranked, _read(spark, a.inputs[5]), a.k), f"{a.output}/metrics.csv")
    return 0


def _generate(spark, a):
    cache = _read(spark, a.inputs[2]) if len(a.inputs) > 2 else f"{a.output}.answers"
    out = flows.generate(_read(spark, a.inputs[0]), _read(spark, a.inputs[1]), providers.extracted_answers, cache)
    for name, rows in out.items():
        _write(rows if name != "reports" else rows.drop("claims"), f"{a.output}/{name}.jsonl")
    return 0


def _environment(spark, a):
    """Versions, settings and the manifests found under a folder."""
    import platform

    facts = [("python", platform.python_version()), ("spark", spark.version), ("platform", platform.platform()), ("cores", str(spark.sparkContext.defaultParallelism))]
    facts += [(f"setting {k}", v) for k, v in spark.sparkContext.getConf().getAll() if k.startswith("spark.sql.")]
    digests = files.file_digests(spark, a.inputs[0])
    return spark.createDataFrame(sorted(facts), "name string, value string").union(digests.select(*(F.col(c).cast("string") for c in digests.columns[:2])))


def _rerun(spark, a):
    found = flows.rerun(_read(spark, a.inputs[0]), _read(spark, a.inputs[-1]), a.system, a.top_k, providers.completed, f"{a.output}.answers", seed=a.seed)
    return found.drop("cached")


def _report(spark, a):
    """Each input as a LaTeX table with its manifest, under its own name."""
    for path in a.inputs:
        manifested.write(_read(spark, path), f"{a.output}/{path.rstrip('/').rpartition('/')[2].rpartition('.')[0]}", "tex")
    return 0


COMMANDS = {
    "corpus": ("documents' folder", 1, _corpus),
    "profile": ("documents' folder", 1, lambda s, a: wordml.style_profile(wordml.read_blocks(s, a.inputs[0]))),
    "ranges": ("documents' folder", 1, lambda s, a: wordml.paragraph_ranges(wordml.read_blocks(s, a.inputs[0]), [tuple(map(int, r.split(":"))) for r in a.range])),
    "bm25": ("questions, children", 2, lambda s, a: retrieval.bm25(_read(s, a.inputs[0]), _read(s, a.inputs[1]), a.limit, a.k1, a.b)),
    "dense": ("query vectors, child vectors", 2, lambda s, a: retrieval.cosine_top_k(_read(s, a.inputs[0]), _read(s, a.inputs[1]), a.limit, "qa_id", "id")),
    "embed": ("rows with id and text", 1, _embed),
    "scores": ("pairs with qa_id, id, question and text", 1, lambda s, a: providers.scored_pairs(_read(s, a.inputs[0]), providers.lexical_scores).select("qa_id", "id", "score")),
    "ladder": ("questions, children, query vectors, child vectors, and perhaps questions with evidence and parents", 4, _ladder),
    "generate": ("questions, sources, and perhaps a cache", 2, _generate),
    "rerun": ("questions, and examples or chunks", 1, _rerun),
    "report": ("tables", 1, _report),
    "environment": ("files", 1, _environment),
    "fuse": ("rankings", 2, _fuse),
    "rerank": ("ranking, scores", 2, _rerank),
    "evaluate": ("questions with evidence, ranking, parents", 3, lambda s, a: retrieval.evaluate(*(_read(s, x) for x in a.inputs), a.k)),
    "contexts": ("ranking, children", 2, lambda s, a: context.context_bundles(*(_read(s, x) for x in a.inputs), a.top_k, a.max_words, a.radius)),
    "verify": ("answers, evidence", 2, _verify),
    "calibrate": ("signals", 1, lambda s, a: calibration.rule_statistics(_read(s, a.inputs[0]))),
    "map": ("chunks, parents", 2, lambda s, a: mapping.lineage(*(_read(s, x) for x in a.inputs))),
    "candidates": ("questions, children", 2, lambda s, a: mapping.child_candidates(*(_read(s, x) for x in a.inputs))),
    "evidence": ("questions, children", 2, lambda s, a: mapping.proposed_evidence(*(_read(s, x) for x in a.inputs))),
    "split": ("records", 1, lambda s, a: splits.grouped_split(_read(s, a.inputs[0]), a.group, a.fraction, a.seed)),
    "sample": ("records", 1, lambda s, a: splits.stratified_sample(_read(s, a.inputs[0]), a.strata, a.limit, a.seed)),
    "freeze": ("candidates, reviews, children, and perhaps a split manifest", 3, _freeze),
    "panel": ("form responses, queue", 2, lambda s, a: review.panel(_read(s, a.inputs[1]), review.votes(review.form_answers(_read(s, a.inputs[0]))), a.min_reviewers, a.unanimous)),
    "pseudonyms": ("form responses with a column order", 1, lambda s, a: review.pseudonyms(_read(s, a.inputs[0]), a.name, "order")),
    "rescore": ("results, benchmark, parents", 3, lambda s, a: baselines.aggregate(materialized(baselines.rescore(*(_read(s, x) for x in a.inputs)), "rescored"))),
}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("command", choices=COMMANDS, help="; ".join(f"{k}: {v[0]}" for k, v in COMMANDS.items()))
    parser.add_argument("inputs", nargs="+")
    parser.add_argument("output")
    for name, kind, value in (("limit", int, 20), ("k1", float, 1.5), ("b", float, 0.75), ("constant", float, 60.0), ("size", int, 64), ("top-k", int, 5), ("max-words", int, 1200), ("radius", int, 0), ("fraction", float, 0.4), ("seed", str, "lodestone-v1"), ("group", str, "parent_id"), ("min-reviewers", int, 2), ("version", str, "2022-12"), ("name", str, "name")):
        parser.add_argument(f"--{name}", type=kind, default=value)
    parser.add_argument("--unanimous", action="store_true")
    parser.add_argument("--system", choices=flows.SYSTEMS, default="rag")
    parser.add_argument("--k", type=int, nargs="*", default=[1, 3, 5, 10, 20])
    parser.add_argument("--strata", nargs="*", default=[])
    parser.add_argument("--range", nargs="*", default=[])
    a = parser.parse_args(args)
    what, least, run = COMMANDS[a.command]
    if len(a.inputs) < least:
        parser.error(f"{a.command} takes {what}")
    spark = spark or SparkSession.builder.appName(f"lodestone {a.command}").getOrCreate()
    with scratch(spark):
        out = run(spark, a)
        if isinstance(out, int):
            return out
        _write(out, a.output)
        _lineage(spark, a.inputs, a.output)
    return 0
