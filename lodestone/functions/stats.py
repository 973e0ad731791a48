"""Column functions for statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share; (0, 1) without trials."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p, whole = successes / n, 1 + z * z / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.coalesce((centre - spread) / whole, F.lit(0.0)), F.coalesce((centre + spread) / whole, F.lit(1.0))


def required_sample(base: Column, target: Column) -> Column:
    """Sample for each group to tell target from base at 5 % and power 0.8; null unless target is higher."""
    mean = (base + target) / 2
    top = 1.96 * F.sqrt(2 * mean * (1 - mean)) + 0.84 * F.sqrt(base * (1 - base) + target * (1 - target))
    return F.when(target > base, F.ceil(top * top / ((target - base) * (target - base))))


def kappa_label(kappa: Column) -> Column:
    out = F.when(kappa.isNull(), "not computable")
    for bound, label in ((0.0, "poor"), (0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial")):
        out = out.when(kappa <= bound, label)
    return out.otherwise("almost perfect")


def lower_percentile(values: Column, share: float) -> Column:
    """The element at int((n - 1) * share) of the sorted values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor((F.size(ordered) - 1) * share).cast("int"))


def distribution(rows: DataFrame, group: list[str], value: str, share: float = 0.95) -> DataFrame:
    """(group, n, mean, median, p95, most) of value: p95 is the element at int((n - 1) * share) of the sorted values. Values are counted first, so what is sorted is the distinct ones."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    own = Window.partitionBy(*group)
    upto = F.sum("__c").over(own.orderBy("__v"))
    placed = counted.withColumns({"__upto": upto, "__n": F.sum("__c").over(own)})
    at = lambda place: F.min(F.when(F.col("__upto") > place, F.col("__v")))
    below, above = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    out = placed.groupBy(*group).agg(F.max("__n").alias("n"), (F.sum(F.col("__v") * F.col("__c")) / F.sum("__c")).alias("mean"), ((at(below) + at(above)) / 2).alias("median"), at(F.floor((F.col("__n") - 1) * share)).alias("p95"), F.max("__v").alias("most"))
    return out
