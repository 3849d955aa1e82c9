"""Anchor frames in intervals, bottom-k by hash, and strata by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.ranking import global_rank


def stride_frames(start: Column, end: Column, stride: int) -> Column:
    """start, start + stride, ... before end."""
    return F.when(end > start, F.sequence(start, end - 1, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def quantile_frames(start: Column, end: Column, quantiles: list[float]) -> Column:
    """The frames at floor(q * (frames - 1)) of the interval, each once, in order of q."""
    at = [start + F.floor((end - start - 1) * F.lit(q)) for q in quantiles]
    return F.when(end > start, F.array_distinct(F.array(*at))).otherwise(F.array().cast("array<bigint>"))


def history_frames(frame: Column, offsets: list[int], least: Column) -> Column:
    """frame + offset for each offset, not before least, each once."""
    return F.array_distinct(F.array(*(F.greatest(frame + k, least) for k in offsets)))


def anchors(df: DataFrame, start: str, end: str, stride: int, quantiles: list[float]) -> DataFrame:
    """A row for each distinct anchor of the grid and of the quantiles."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    return df.withColumn("anchor", F.explode(F.array_union(stride_frames(s, e, stride), quantile_frames(s, e, quantiles))))


def bottom_k(df: DataFrame, cell: list[str], key: str, k: int, seed: str = "42") -> DataFrame:
    """The k rows of each cell whose key has the least seeded hash; tasks keep k of a cell before the shuffle."""
    score = F.sha2(F.concat_ws("\x00", F.lit(seed), F.col(key).cast("string")), 256)
    nth = Window.partitionBy(*cell).orderBy("score", key)
    return df.withColumn("score", score).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k)


def rank_strata(df: DataFrame, order: list[str], strata: int) -> DataFrame:
    """df and ``stratum``: min(strata - 1, rank * strata div rows), with rank from 0 in the whole table's order."""
    ranked, rows = global_rank(df, order)
    return ranked.withColumn("stratum", F.least(F.lit(strata - 1), F.floor(F.col("rank") * strata / F.lit(max(1, rows)))).cast("int"))


def at_positions(df: DataFrame, order: list[str], positions: list[str]) -> DataFrame:
    """The rows of df at some places of the whole order, with ``rank``; places are SQL expressions of ``last``, the last place."""
    ranked, rows = global_rank(df, order)
    places = F.array_distinct(F.array(*(F.expr(x.replace("last", f"{max(0, rows - 1)}L")).cast("long") for x in positions)))
    return ranked.where(F.array_contains(places, F.col("rank").cast("long")))


def boundary_frames(start: Column, end: Column) -> Column:
    """First, middle and last frame of an interval, each once."""
    return F.array_sort(F.array_distinct(F.array(start, F.floor((start + end - 1) / 2).cast("long"), end - 1)))


def late_frames(start: Column, end: Column, stride: int, percent: int = 30) -> Column:
    """Every stride-th frame of an interval's last percentage, which begins at a whole frame (rounded up), by whole numbers alone."""
    first = start + F.floor(((end - start) * (100 - percent) + 99) / 100).cast("long")
    return F.when(first < end, F.sequence(first, end - 1, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def stage(nth: Column, rows: Column, terminal: Column) -> Column:
    """Where a row stands in its episode; nth from 0."""
    return F.when(terminal, "terminal").when(nth == 0, "initial").when(nth * 4 < rows, "start").otherwise("process")


def highlights(df: DataFrame, key: str, order: str, terminal: Column) -> DataFrame:
    """(key, first, middle, last_terminal): the first row of each key, the one in the middle and the last terminal one, by order."""
    by_order = Window.partitionBy(key).orderBy(order)
    own = df.select(key, order, terminal.alias("__t")).withColumns({"__n": F.row_number().over(by_order) - 1, "__c": F.count(F.lit(1)).over(Window.partitionBy(key))})
    return own.groupBy(key).agg(F.min(order).alias("first"), F.max(F.when(F.col("__n") == F.expr("__c div 2"), F.col(order))).alias("middle"), F.max(F.when(F.col("__t"), F.col(order))).alias("last_terminal"))


def balanced(df: DataFrame, key: str, cost: str, workers: int) -> DataFrame:
    """df and ``worker``: dealt in order of falling cost forth and back over the workers, which keeps loads within one largest cost of each other without a sequential pass."""
    ranked, _ = global_rank(df.withColumn("__cost", -F.col(cost)), ["__cost", key])
    lap, at = F.floor(F.col("rank") / workers), F.col("rank") % workers
    return ranked.withColumn("worker", F.when(lap % 2 == 0, at).otherwise(workers - 1 - at).cast("int")).drop("__cost")
