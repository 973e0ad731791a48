"""Word-budgeted evidence contexts: greedy anchors, neighbours, final order and prompt text.

The folds run over one record's ranked candidates, so they are array aggregates in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "struct<id:string,parent_id:string,sequence:int,words:int,rank:int,anchor:string>"
STATE = f"struct<taken:array<{ITEM}>,words:int,skipped:array<string>>"


def _keep(state, item, words):
    return F.struct(F.concat(state["taken"], F.array(item)).alias("taken"), (state["words"] + words).cast("int").alias("words"), state["skipped"].alias("skipped"))


def _skip(state, item):
    return F.struct(state["taken"].alias("taken"), state["words"].alias("words"), F.concat(state["skipped"], F.array(item["id"])).alias("skipped"))


def anchors(ranked, top_k: int, max_words: int, max_per_parent: int | None):
    """Fold over ranked items: skips a full parent silently, skips and logs what exceeds the budget (but for the first anchor), stops at top_k."""
    start = F.struct(F.array().cast(f"array<{ITEM}>").alias("taken"), F.lit(0).alias("words"), F.array().cast("array<string>").alias("skipped")).cast(STATE)

    def step(state, item):
        full = F.size(state["taken"]) >= top_k
        same = F.size(F.filter(state["taken"], lambda t: t["parent_id"] == item["parent_id"])) >= (max_per_parent or 1 << 30)
        over = (F.size(state["taken"]) > 0) & (state["words"] + item["words"] > max_words)
        return F.when(full | same, state).when(over, _skip(state, item)).otherwise(_keep(state, item, item["words"])).cast(STATE)

    return F.aggregate(ranked, start, step)


def neighbours(state, candidates, max_words: int):
    """Fold over neighbour items in anchor order: what is taken already is passed over, what exceeds the budget is logged."""

    def step(s, item):
        held = F.exists(s["taken"], lambda t: t["id"] == item["id"])
        return F.when(held, s).when(s["words"] + item["words"] > max_words, _skip(s, item)).otherwise(_keep(s, item, item["words"])).cast(STATE)

    return F.aggregate(candidates, state, step)


def context_bundles(rankings: DataFrame, children: DataFrame, top_k: int = 5, max_words: int = 1200, radius: int = 0, max_per_parent: int | None = None) -> DataFrame:
    """(qa_id, source_ids, anchor_count, neighbor_count, evidence_words, skipped) of every record of rankings (qa_id, rank, child_id).

    children: child_id, parent_id, sequence, word_count. Sources are ordered by anchor rank, parent, sequence and id. A
    child that children lacks, or that a ranking names twice, is an error.
    """
    if top_k < 1 or max_words < 1 or radius < 0 or max_per_parent is not None and max_per_parent < 1:
        raise ValueError("top_k, max_words and max_per_parent must be positive, radius must not be negative")
    known = children.select(F.col("child_id").alias("id"), F.col("parent_id").cast("string").alias("parent_id"), F.col("sequence").cast("int"), F.col("word_count").cast("int").alias("words"))
    own = rankings.select("qa_id", F.col("rank").cast("int"), F.col("child_id").alias("id")).join(known, "id", "left")
    item = F.struct("id", F.when(F.col("words").isNull(), F.raise_error(F.lit("unknown child"))).otherwise(F.col("parent_id")).alias("parent_id"), "sequence", "words", "rank", F.col("id").alias("anchor")).cast(ITEM)
    lists = own.groupBy("qa_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("l"), F.count_distinct("id").alias("n"))
    ranked = F.when(F.col("n") == F.size("l"), F.transform("l", lambda x: x["item"])).otherwise(F.raise_error(F.lit("duplicate child in a ranking")).cast(f"array<{ITEM}>"))
    chosen = lists.select("qa_id", anchors(ranked, top_k, max_words, max_per_parent).alias("s"))
    if radius:
        a = chosen.select("qa_id", F.explode("s.taken").alias("a"))
        k = known.select(F.struct("*").alias("k"))
        near = a.join(k, (F.col("k.parent_id") == F.col("a.parent_id")) & F.col("k.sequence").between(F.col("a.sequence") - radius, F.col("a.sequence") + radius))
        near = near.select("qa_id", F.struct(F.col("a.rank").alias("r"), F.col("k.sequence").alias("q"), F.struct("k.id", "k.parent_id", "k.sequence", "k.words", "a.rank", F.col("a.id").alias("anchor")).cast(ITEM).alias("item")).alias("x"))
        grouped = near.groupBy("qa_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
        chosen = chosen.join(grouped, "qa_id", "left").select("qa_id", F.size("s.taken").alias("n"), neighbours(F.col("s"), F.coalesce(F.transform("x", lambda y: y["item"]), F.array().cast(f"array<{ITEM}>")), max_words).alias("s"))
    else:
        chosen = chosen.select("qa_id", F.size("s.taken").alias("n"), "s")
    order = F.array_sort(F.transform("s.taken", lambda t: F.struct(t["rank"], t["parent_id"], t["sequence"], t["id"])))
    return chosen.select("qa_id", F.transform(order, lambda t: t["id"]).alias("source_ids"), F.col("n").alias("anchor_count"), (F.size("s.taken") - F.col("n")).alias("neighbor_count"), F.col("s.words").alias("evidence_words"), F.col("s.skipped").alias("skipped"))


def prompt_context(sources: DataFrame) -> DataFrame:
    """(qa_id, prompt_context) of sources (qa_id, position, source_id, citation, document_id, document_type, version, path array, text): six lines each, a blank line between."""
    # The labels of a source's lines.
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("[SOURCE "), "source_id", F.lit("]")),
        F.concat(F.lit("Citation: "), "citation"),
        F.concat(F.lit("Document: "), "document_id", F.lit(" ("), "document_type", F.lit(")")),
        F.concat(F.lit("Version: "), "version"),
        F.concat(F.lit("Hierarchy: "), F.array_join("path", " > ")),
        F.concat(F.lit("Evidence: "), "text"),
    )
    listed = sources.groupBy("qa_id").agg(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))).alias("l"))
    return listed.select("qa_id", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("prompt_context"))
