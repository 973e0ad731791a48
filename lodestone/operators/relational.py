"""Small checks and joins that the larger operators and the command lines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import materialized


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only a or only b has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("a")).union(right.join(left, key, "left_anti").withColumn("side", F.lit("b")))


def field_differences(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) of joined rows that differ in a field; nulls are equal to each other."""
    right = b.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    flags = F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields))
    return a.join(right, key).select(key, F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("field"))


def require_empty(rows: DataFrame, message: str) -> None:
    """ValueError with the message and a few rows if there are any."""
    if found := rows.limit(5).collect():
        raise ValueError(f"{message}: {[tuple(r) for r in found]}")


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    own = parents.select(F.col(parent_key or key).alias("__key")).distinct()
    return children.join(own, F.col(key) == F.col("__key"), "left_anti")


def overridden(rows: DataFrame, overrides: DataFrame, key: str, field: str, new: str) -> DataFrame:
    """rows with field replaced where overrides has a value, and source telling which it is."""
    own = overrides.select(key, F.col(new).alias("__new"))
    joined = rows.join(own, key, "left")
    return joined.withColumn("source", F.when(F.col("__new").isNull(), "derived").otherwise("manual")).withColumn(field, F.coalesce("__new", field)).drop("__new")


def siblings(anchors: DataFrame, children: DataFrame, radius: int) -> DataFrame:
    """(anchor_id, child_id, offset): children of an anchor's parent within radius positions of it."""
    a = anchors.select(F.col("child_id").alias("anchor_id"), F.col("parent_id"), F.col("sequence").alias("at"))
    return a.join(children.select("child_id", "parent_id", "sequence"), "parent_id").where(F.abs(F.col("sequence") - F.col("at")) <= radius).select("anchor_id", "child_id", (F.col("sequence") - F.col("at")).alias("offset"))


def counted(parents: DataFrame, children: DataFrame, key: str, name: str = "n") -> DataFrame:
    """parents' keys with the number of their children, zero for none."""
    return parents.select(key).join(children.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").select(key, F.coalesce(name, F.lit(0)).alias(name))


def filled_down(rows: DataFrame, group: list[str], order: str, value: str, restart: str) -> DataFrame:
    """rows with value, where null, filled from the last row of its group that restarted."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.coalesce(F.col(value), F.last(F.when(F.col(restart), F.col(value)), ignorenulls=True).over(w)))


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """rows with their place from 1 in a total order, without a window over all of them: ranges are numbered by themselves, and each begins where those before it end."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialized(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")  # a row for each partition
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__own", own).join(F.broadcast(ranges), "__range").withColumn(name, F.col("__own") + F.col("before")).drop("__range", "__own", "before")
