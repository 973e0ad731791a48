"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")), "least")  # a table, so that both sides of the join have a plain exchange, which Spark can split at the centre of a star
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) for every node a of edges (a, b) but the least of its component, which is b. Node ids are longs; nothing is brought to the driver but counts."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        large = cut(_large(edges).where("a <> b").distinct(), "edges")
        edges = cut(_small(large).where("a <> b").distinct(), "edges")
        if (now := _mark(edges)) == mark:
            break
        mark = now
    return edges
