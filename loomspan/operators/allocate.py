"""Whole-number apportionment of a total by weights, and replay of small leaves.

The input has a row for each bucket, so these windows are over a few rows. All
arithmetic is on whole numbers: no rounding decides a tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def largest_remainder(buckets: DataFrame, name: str, weight: str, total: int, last_name_first: bool = False) -> DataFrame:
    """buckets and ``share``: floors first, then one more by largest remainder; ties by name."""
    whole = Window.partitionBy(F.lit(0))
    product = F.col(weight).cast("long") * F.lit(total)
    out = buckets.withColumn("__sum", F.sum(F.col(weight).cast("long")).over(whole)).withColumns({"__floor": F.expr(f"cast({weight} as bigint) * {total}L div __sum"), "__rest": product % F.col("__sum")})
    out = out.withColumn("__left", F.lit(total) - F.sum("__floor").over(whole))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("__rest").desc(), F.col(name).desc() if last_name_first else F.col(name).asc())
    return out.withColumn("share", F.col("__floor") + (F.row_number().over(order) <= F.col("__left")).cast("long")).drop("__sum", "__floor", "__rest", "__left")


def mix_budget(buckets: DataFrame, count: str, weight: str) -> DataFrame:
    """One row, ``budget``: the most that keeps the weights without repeating a row, 1 at least."""
    return buckets.where(F.col(weight) > 0).agg(F.greatest(F.lit(1), F.floor(F.min(F.col(count) / F.col(weight)))).cast("long").alias("budget"))


def replay(leaves: DataFrame, wanted: str, size: str) -> DataFrame:
    """A row for each pass over a leaf: ``pass`` from 1, and ``take``, at most the leaf's size."""
    passes = F.ceil(F.col(wanted) / F.col(size)).cast("long")
    rows = leaves.where((F.col(wanted) > 0) & (F.col(size) > 0)).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), passes)))
    return rows.withColumn("take", F.least(F.col(size), F.col(wanted) - (F.col("pass") - 1) * F.col(size)))


def with_quota(buckets: DataFrame, name: str, weight: str, total: int, fixed: str, percent: int) -> DataFrame:
    """largest_remainder of what is left after one bucket's fixed percentage (rounded half to even); ties by the last name first."""
    scaled = total * percent
    quota = scaled // 100 + (1 if scaled % 100 > 50 or (scaled % 100 == 50 and scaled // 100 % 2) else 0)
    rest = largest_remainder(buckets.where(F.col(name) != fixed), name, weight, total - quota, last_name_first=True)
    return rest.unionByName(buckets.where(F.col(name) == fixed).withColumn("share", F.lit(quota).cast("long")))


def least_total(leaves: DataFrame, source: str, size: str, weights: dict[str, int], quantum: int) -> DataFrame:
    """One row, ``total``: the least multiple of quantum that covers every source's rows at its percentage."""
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    own = leaves.groupBy(source).agg(F.sum(size).alias("n")).withColumn("w", F.try_element_at(weight, F.col(source))).where("w is not null")
    need = F.max(F.expr("(n * 100 + w - 1) div w"))
    return own.agg((F.floor((need + (quantum - 1)) / quantum) * quantum).cast("long").alias("total"))


def above_minimum(leaves: DataFrame, name: str, size: str, least: str, total: int) -> DataFrame:
    """leaves and ``share``: each its minimum, and the rest by largest remainder of the sizes, ties by the last name first."""
    spare = leaves.agg((F.lit(total) - F.sum(least)).alias("__spare")).first()[0]  # one number
    if spare is None or spare < 0:
        raise ValueError("the total is less than the sum of the minimums")
    return largest_remainder(leaves, name, size, spare, last_name_first=True).withColumn("share", F.col("share") + F.col(least))
