"""Leakage-safe grouped splits and stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.relational import numbered
from lodestone.sources.shared import materialized


def grouped_split(records: DataFrame, group: str = "parent_id", fraction: float = 0.4, seed: str = "lodestone-v1") -> DataFrame:
    """records (qa_id, group) with split, development or test, the same for all records of a group.

    Groups are taken by falling size, then by SHA-256 of seed:group; one goes to development if that brings it no
    further from its share; the last makes up an empty test side. Of groups of one size the first go to development, as
    many as fit. So only the distinct sizes, of which n records have no more than the root of 2n, are read in order, in one
    task; which groups of a size are first follows from their numbers. ValueError for fewer than two groups.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    named = records.withColumn("__g", F.col(group).cast("string"))
    sizes = materialized(named.groupBy(F.col("__g").alias("g")).agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), "g"), 256)), "sizes")
    groups, total, target = sizes.agg(F.count(F.lit(1)), F.sum("n"), F.bround(F.sum("n") * fraction, 0)).first()
    if groups < 2:
        raise ValueError("at least two groups are required")
    target = float(target)

    def fold(batches):
        import pyarrow as pa

        dev = before = 0
        for batch in batches:
            rows = []
            for n, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fits = min(many, max(0, int((2 * (target - dev) - n) // (2 * n)) + 1))
                rows.append((n, before, before + fits))
                dev, before = dev + fits * n, before + many
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["n", "before", "upto"])

    classes = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("many")).repartition(1).sortWithinPartitions(F.desc("n"))
    bounds = classes.mapInArrow(fold, "n long, before long, upto long")
    placed = numbered(sizes, [F.desc("n"), F.asc("h"), F.asc("g")]).join(bounds, "n")
    sides = materialized(placed.select("g", "number", (F.col("number") <= F.col("upto")).alias("dev")), "sides")
    others = sides.where(F.col("number") < groups).agg(F.count_if(~F.col("dev")), F.count_if("dev")).first()
    last = F.lit("development" if others[0] else "test")
    sides = sides.select("g", F.when(F.col("number") == groups, last).otherwise(F.when(F.col("dev"), "development").otherwise("test")).alias("split"))
    return named.join(sides, F.col("__g").eqNullSafe(F.col("g"))).drop("__g", "g")


def inherited_split(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """records with the split of manifest (qa_id, split); an error for a record without one."""
    joined = records.join(manifest.select("qa_id", "split"), "qa_id", "left")
    known = F.coalesce(F.col("split").isin("development", "test"), F.lit(False))
    return joined.withColumn("split", F.when(known, F.col("split")).otherwise(F.raise_error(F.concat(F.lit("no known split for "), F.col("qa_id").cast("string"))).cast("string")))


def leaks(assigned: DataFrame, group: str = "parent_id") -> DataFrame:
    """(group, splits) of groups in more than one split."""
    return assigned.groupBy(group).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def stratified_sample(records: DataFrame, strata: list[str], n: int, seed: str, key: str = "qa_id") -> DataFrame:
    """The n records of each stratum with the least SHA-256 of seed:key."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return records.withColumn("__n", F.row_number().over(Window.partitionBy(*strata).orderBy(order, key))).where(F.col("__n") <= n).drop("__n")


def exemplars(queries: DataFrame, pool: DataFrame, k: int, seed: str, key: str = "qa_id") -> DataFrame:
    """(q, rank, exemplar): k records of the pool for each query, its own sample, never itself.

    The pool stands in the order of SHA-256 of seed:key, as in a circle; a query starts at the place that SHA-256 of
    seed:q:key says, and takes the k records from there that are not itself (all others if the pool has no more).
    """
    digest = lambda column, more="": F.sha2(F.concat(F.lit(f"{seed}:{more}"), F.col(column).cast("string")), 256)
    placed = numbered(pool.select(F.col(key).alias("exemplar")).distinct(), [digest("exemplar"), F.col("exemplar")])
    placed = materialized(placed.select("exemplar", (F.col("number") - 1).cast("long").alias("place")), "pool")
    n = placed.count()
    if not n:
        return queries.select(F.col(key).alias("q"), F.lit(0).alias("rank"), F.col(key).alias("exemplar")).limit(0)
    start = F.conv(F.left(digest(key, "q:"), F.lit(12)), 16, 10).cast("long") % n
    steps = queries.select(F.col(key).alias("q"), start.alias("start")).distinct().select("q", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(min(k, n - 1))), lambda i: (F.col("start") + i) % n)).alias("step", "place"))
    found = steps.join(placed, "place").where("q != exemplar")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("step"))).where(F.col("rank") <= k).select("q", "rank", "exemplar")
