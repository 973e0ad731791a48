"""Escalation signals, rules and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.stats import required_sample, wilson
from lodestone.functions.text import word_count

# The candidate rules.
RULES = {
    "reranker moved top-1 by >= 2 ranks": "top1_rank_shift >= 2",
    "reranker moved top-1 by >= 3 ranks": "top1_rank_shift >= 3",
    "reranker moved top-1 by >= 5 ranks": "top1_rank_shift >= 5",
    "rerank margin <= 0.5": "rerank_margin <= 0.5",
    "rerank margin <= 1.0": "rerank_margin <= 1.0",
    "rerank margin <= 1.5": "rerank_margin <= 1.5",
    "cited <= 1 distinct source": "distinct_sources_cited <= 1",
    "cited <= 2 distinct sources": "distinct_sources_cited <= 2",
    "only one claim made": "claim_count <= 1",
    "quote verification failed": "quote_pass = 0",
    "byte-strict quote check failed": "quote_pass_strict = 0",
    "model abstained": "model_abstained = 1",
    "moved >= 2 ranks OR quote failed": "top1_rank_shift >= 2 OR quote_pass = 0",
}
# Fixed value: the share of questions that an escalation is taken to meet.
SEEN_SHARE = 0.45


def margins(rankings: DataFrame, digits: int = 6) -> DataFrame:
    """(qa_id, top1, margin, top5_mean, parents_top5) of rankings (qa_id, rank, score, parent_id); the margin of a single candidate is its score."""
    first = rankings.where("rank <= 5")
    score = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    return first.groupBy("qa_id").agg(
        F.round(score(1), digits).alias("top1"),
        F.round(score(1) - F.coalesce(score(2), F.lit(0.0)), digits).alias("margin"),
        F.round(F.avg("score"), digits).alias("top5_mean"),
        F.count_distinct("parent_id").alias("parents_top5"),
    )


def signals(answers: DataFrame, reranked: DataFrame, hybrid: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Signals and outcomes of every answer.

    answers: qa_id, split, answer_text, claim_count, cited array, quote_pass, quote_pass_strict, elided, abstained;
    reranked: qa_id, rank, child_id, parent_id, score, original_rank; hybrid: qa_id, rank, score, parent_id; benchmark:
    qa_id, gold_child_ids, acceptable_parent_ids.
    """
    re_m = margins(reranked).withColumnsRenamed({"top1": "rerank_top1_score", "margin": "rerank_margin", "top5_mean": "rerank_top5_mean", "parents_top5": "distinct_parents_top5"})
    shift = reranked.where("rank = 1").select("qa_id", F.abs(F.col("original_rank") - 1).alias("top1_rank_shift"))
    hy_m = margins(hybrid, 8).select("qa_id", F.col("margin").alias("hybrid_margin"))
    cited = answers.select("qa_id", F.explode("cited").alias("child_id")).join(reranked.select("qa_id", "child_id", "parent_id"), ["qa_id", "child_id"]).groupBy("qa_id").agg(F.collect_set("parent_id").alias("cited_parents"))
    joined = answers.join(re_m, "qa_id").join(shift, "qa_id").join(hy_m, "qa_id").join(benchmark.select("qa_id", "gold_child_ids", "acceptable_parent_ids"), "qa_id").join(cited, "qa_id", "left")
    meets = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False)).cast("int")
    return joined.select(
        "qa_id",
        "split",
        *("rerank_top1_score rerank_margin rerank_top5_mean top1_rank_shift hybrid_margin distinct_parents_top5 claim_count".split()),
        F.size(F.array_distinct("cited")).alias("distinct_sources_cited"),
        word_count(F.col("answer_text")).alias("answer_words"),
        *(F.coalesce(F.col(c), F.lit(False)).cast("int").alias(n) for c, n in (("quote_pass", "quote_pass"), ("quote_pass_strict", "quote_pass_strict"), ("elided", "elided_quote"), ("abstained", "model_abstained"))),
        meets("cited", "gold_child_ids").alias("evidence_correct"),
        meets("cited_parents", "acceptable_parent_ids").alias("parent_correct"),
    )


def fired(rows: DataFrame, rules: dict[str, str], error: str) -> DataFrame:
    """(rule, fired, error): a row for each record and rule."""
    flags = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(F.expr(e), F.lit(False)).alias("fired")) for n, e in rules.items()))
    return rows.select(F.explode(flags).alias("r"), F.expr(error).alias("error")).select("r.rule", "r.fired", "error")


def rule_statistics(rows: DataFrame, rules: dict[str, str] = RULES, error: str = "evidence_correct = 0") -> DataFrame:
    """Of every rule: escalated, its rate, errors_caught, precision with its Wilson bounds, recall, and whether the lower bound beats the base rate."""
    both = F.col("fired") & F.col("error")
    sums = fired(rows, rules, error).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("fired").alias("escalated"), F.count_if(both).alias("errors_caught"), F.count_if("error").alias("errors"))
    low, high = wilson(F.col("errors_caught"), F.col("escalated"))
    some = F.col("escalated") > 0
    return sums.select(
        "rule",
        "escalated",
        F.round(F.col("escalated") / F.col("n"), 4).alias("escalation_rate"),
        "errors_caught",
        F.when(some, F.round(F.col("errors_caught") / F.col("escalated"), 4)).alias("precision"),
        F.when(some, F.round(low, 4)).alias("ci_low"),
        F.when(some, F.round(high, 4)).alias("ci_high"),
        F.when(F.col("errors") > 0, F.round(F.col("errors_caught") / F.col("errors"), 4)).alias("recall"),
        (some & (low > F.col("errors") / F.col("n"))).alias("beats_base_rate"),
    )


def failure_overlap(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, a, b, both, either."""
    x, y = F.coalesce(F.expr(a), F.lit(False)), F.coalesce(F.expr(b), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(x).alias("a"), F.count_if(y).alias("b"), F.count_if(x & y).alias("both"), F.count_if(x | y).alias("either"))


def sample_sizes(rows: DataFrame, error: str, targets: tuple[float, ...] = (0.35, 0.42, 0.5, 0.6)) -> DataFrame:
    """(target, decisions, questions) to tell each precision from the base error rate."""
    base = rows.agg(F.avg(F.expr(error).cast("double")).alias("base"))
    each = base.select("base", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    need = required_sample(F.col("base"), F.col("target"))
    return each.select("target", need.alias("decisions"), F.ceil(need / SEEN_SHARE).alias("questions"))


def last_known(rows: DataFrame, group: list[str], order: list[str], value, name: str) -> DataFrame:
    """rows with the last non-null value up to and with each row of its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))
