"""Half-open intervals [start, end) of integers, grouped by a key.

Range joins deal both sides into bins of a fixed width and join on (key, bin), so a hot
key is spread over its bins; a pair is kept only in the bin where its overlap begins,
so it comes once. Intervals that are empty, or have a null, meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_failing_rule(start: Column, end: Column, limit: Column, previous_end: Column, least: int) -> Column:
    """The first rule that an interval breaks, or ``ok``."""
    return (
        F.when(start.isNull() | end.isNull(), "missing")
        .when(end <= start, "empty")
        .when((start < 0) | (end > limit), "out_of_range")
        .when(end - start < least, "short")
        .when(start < previous_end, "overlap")
        .otherwise("ok")
    )


def validate_intervals(df: DataFrame, key: list[str], start: str, end: str, limit: Column, least: int, order: list[str]) -> DataFrame:
    """df and ``reason``. An interval overlaps if the one before it in its key has a later end."""
    before = Window.partitionBy(*key).orderBy(start, *order)
    return df.withColumn("reason", first_failing_rule(F.col(start), F.col(end), limit, F.lag(end).over(before), least))


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    return df.where(F.col(end) > F.col(start)).withColumn("__bin", F.explode(bins))


def overlaps(left: DataFrame, right: DataFrame, key: list[str], width: int) -> DataFrame:
    """Pairs of a key that overlap, with ``lo`` and ``hi`` of what they share.

    left has l_start and l_end, right has r_start and r_end; no other column may be in
    both but the key.
    """
    both = _binned(left, "l_start", "l_end", width).join(_binned(right, "r_start", "r_end", width), [*key, "__bin"])
    lo = F.greatest("l_start", "r_start")
    meets = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    return both.where(meets & (F.floor(lo / width) == F.col("__bin"))).withColumns({"lo": lo, "hi": F.least("l_end", "r_end")}).drop("__bin")


def contained(children: DataFrame, parents: DataFrame, key: list[str], width: int) -> DataFrame:
    """Pairs whose l interval lies in the r interval. A child is looked up in the bin of its start alone."""
    child = children.where("l_end > l_start").withColumn("__bin", F.floor(F.col("l_start") / width))
    both = child.join(_binned(parents, "r_start", "r_end", width), [*key, "__bin"])
    return both.where((F.col("r_start") <= F.col("l_start")) & (F.col("l_end") <= F.col("r_end"))).drop("__bin")


def best_overlap(left: DataFrame, right: DataFrame, key: list[str], left_id: str, right_id: str, width: int) -> DataFrame:
    """For each left interval the right one of most overlap; ties go to the earliest start, end, then id."""
    pairs = overlaps(left, right, key, width)
    rank = F.struct((F.col("lo") - F.col("hi")).alias("minus"), "r_start", "r_end", right_id)
    return pairs.groupBy(*key, left_id).agg(F.min(rank).alias("best")).select(*key, left_id, F.col(f"best.{right_id}").alias(right_id), (-F.col("best.minus")).alias("overlap"))


def as_of(points: DataFrame, states: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """points and ``value`` of the last state of their key at or before them (null if none).

    One sort of both sides by key and time instead of a join: no pair is ever made. At
    equal times the state of the highest value counts.
    """
    marked = states.groupBy(*key, at).agg(F.max(value).alias(value)).withColumn("__point", F.lit(0))
    every = points.withColumns({value: F.lit(None).cast(states.schema[value].dataType), "__point": F.lit(1)}).unionByName(marked, allowMissingColumns=True)
    until = Window.partitionBy(*key).orderBy(at, "__point").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn(value, F.last(value, ignorenulls=True).over(until)).where("__point = 1").drop("__point")


def dense_units(points: DataFrame, units: DataFrame, key: list[str], point: str, at: str, unit: str, start: str, end: str, width: int) -> DataFrame:
    """(key, point, at, unit, matched, status): the unit that each point is given, and why.

    One unit that holds it: ``matched``. Several: the first of them by start and id, as
    ``ambiguous_overlap_schema_proxy``. None: the last unit that began at or before the
    point, else the key's first one, as ``unlabelled_gap_schema_proxy``; null if the key
    has none.
    """
    own = points.select(*key, point, F.col(at).alias("__at"))
    left = own.select(*key, F.col(point).alias("l_id"), F.col("__at").alias("l_start"), (F.col("__at") + 1).alias("l_end"))
    right = units.select(*key, F.col(unit).alias("r_id"), F.col(start).alias("r_start"), F.col(end).alias("r_end"))
    held = overlaps(left, right, key, width).groupBy(*key, F.col("l_id").alias(point)).agg(F.count(F.lit(1)).alias("__n"), F.min_by("r_id", F.struct("r_start", "r_id")).alias("__first"))
    began = as_of(own, units.select(*key, F.col(start).alias("__at"), F.col(unit).alias("__last")), key, "__at", "__last")
    first = units.groupBy(*key).agg(F.min_by(unit, F.struct(start, unit)).alias("__head"))
    out = began.join(held, [*key, point], "left").join(first, key, "left")
    status = F.when(F.col("__n") == 1, "matched").when(F.col("__n") > 1, "ambiguous_overlap_schema_proxy").when(F.col("__head").isNotNull(), "unlabelled_gap_schema_proxy")
    return out.select(*key, point, F.col("__at").alias(at), F.coalesce("__first", "__last", "__head").alias(unit), F.coalesce(F.col("__n") == 1, F.lit(False)).alias("matched"), status.alias("status"))
