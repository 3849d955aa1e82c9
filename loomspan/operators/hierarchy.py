"""Three levels of labelled intervals in an episode: links, profiles, targets and samples.

Units are rows (episode, level, id, start, end) with half-open intervals; levels are 2
(coarse) to 0 (fine). All steps are joins and windows by episode; range joins go through
bins (``intervals.overlaps``), so a long episode is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.progress import interval_progress
from loomspan.functions.text import is_latin_caption
from loomspan.operators import intervals
from loomspan.operators.ranking import checkpointed

#: The profiles in order of precedence, with the levels that each needs.
PROFILES = {"full": (2, 1, 0), "L3L2L1": (2, 1), "L3L2L0": (2, 0), "L3L2": (2,), "L3L1L0": (1, 0), "L3L1": (1,), "L3L0": (0,)}
BIN = 256


def _level(units: DataFrame, level: int, side: str) -> DataFrame:
    return units.where(F.col("level") == level).select("episode", F.col("id").alias(f"{side}_id"), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"))


def links(units: DataFrame, parent: int, child: int) -> DataFrame:
    """(episode, r_id, r_start, r_end, n_parents, l_id): every child unit with how many parents hold it whole, and the first of them."""
    own = _level(units, child, "r")
    held = intervals.overlaps(_level(units, parent, "l"), own, ["episode"], BIN).where("lo = r_start and hi = r_end")
    found = held.groupBy("episode", "r_id").agg(F.count(F.lit(1)).alias("n_parents"), F.min_by("l_id", F.struct("l_start", "l_id")).alias("l_id"))
    return own.join(found, ["episode", "r_id"], "left").withColumn("n_parents", F.coalesce("n_parents", F.lit(0)))


def nested(units: DataFrame, parent: int, child: int) -> DataFrame:
    """(episode, ok): whether every child has exactly one parent, and every parent a child; episodes with units of both levels."""
    down = links(units, parent, child)
    children = down.groupBy("episode").agg(F.max((F.col("n_parents") != 1).cast("int")).alias("bad"), F.count_distinct(F.when(F.col("n_parents") == 1, F.col("l_id"))).alias("used"))
    parents = units.where(F.col("level") == parent).groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    return children.join(parents, "episode").select("episode", ((F.col("bad") == 0) & (F.col("used") == F.col("n"))).alias("ok"))


def profiles(units: DataFrame, least: dict[int, int]) -> DataFrame:
    """(episode, n2, n1, n0, profile): the first profile whose levels exist in sufficient number and nest; null if none."""
    units = checkpointed(units)  # read by each pair of levels
    counts = units.groupBy("episode").agg(*(F.count_if(F.col("level") == k).alias(f"n{k}") for k in (2, 1, 0)))
    out = counts
    for a, b in ((2, 1), (2, 0), (1, 0)):
        out = out.join(nested(units, a, b).withColumnRenamed("ok", f"ok{a}{b}"), "episode", "left")
    tests = []
    for name, levels in PROFILES.items():
        test = F.lit(True)
        for k in levels:
            test &= F.col(f"n{k}") >= least.get(k, 1)
        for a, b in zip(levels, levels[1:], strict=False):
            test &= F.coalesce(F.col(f"ok{a}{b}"), F.lit(False))
        tests.append(F.when(test, name))
    return out.select("episode", "n2", "n1", "n0", F.coalesce(*tests).alias("profile"))


def verdicts(units: DataFrame, limit: Column, least: int) -> DataFrame:
    """(episode, level, unit, reason): the first unit by time of each level that breaks a rule. units also has caption and source."""
    own = Window.partitionBy("episode", "level")
    one = units.withColumns({"__before": F.lag("end").over(own.orderBy("start", "end")), "__same": F.count(F.lit(1)).over(Window.partitionBy("episode", "level", "id"))})
    reason = (
        F.when(F.col("__same") > 1, "duplicate_unit_id")
        .when(~is_latin_caption(F.col("caption")), "invalid_caption")
        .when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > limit), "interval_out_of_bounds")
        .when(F.col("end") - F.col("start") < least, "interval_too_short")
        .when(F.col("start") < F.col("__before"), "same_level_overlap")
        .when((F.col("level") == 0) & ~F.col("source").isin("human_segment", "segment"), "invalid_l0_source")
    )
    bad = one.withColumn("reason", reason).where("reason is not null")
    return bad.groupBy("episode", "level").agg(F.min_by(F.struct(F.col("id").alias("unit"), "reason"), F.struct("start", "end", "id")).alias("x")).select("episode", "level", "x.*")


def grid_anchors(units: DataFrame, ranges: DataFrame, level: int, stride: int) -> DataFrame:
    """(episode, frame, forced): the frames of one grid from an episode's first unit on that lie in a labelled range; where the last unit gets none, its first labelled frame is forced."""
    ranges = checkpointed(ranges)  # read twice, as spans are
    spans = units.where(F.col("level") == level).groupBy("episode").agg(F.min("start").alias("first"), F.max("end").alias("end"), F.max_by("id", F.struct("start", "end")).alias("unit"))
    spans = checkpointed(spans)  # with its own exchange below the join, a hot episode's ranges can be split
    # a range's frames are reckoned, not looked up: an episode's grid as a side of a join is many times what its size is taken for, and would be broadcast
    step, lo, hi = F.lit(stride).cast("long"), F.greatest("lo", "first"), F.least("hi", "end")
    at = lo + F.pmod(F.col("first") - lo, step)
    meets = F.coalesce((F.col("hi") > F.col("lo")) & (F.col("end") > F.col("first")) & (at < hi), F.lit(False))
    held = ranges.join(spans.drop("unit"), "episode").select("episode", F.explode(F.when(meets, F.sequence(at, hi - 1, step))).alias("frame"), F.lit(False).alias("forced"))
    last = ranges.join(spans, ["episode", "unit"]).groupBy("episode", "unit").agg(F.min("lo").alias("frame"), F.max(meets).alias("met"))
    every = held.unionByName(last.where("not met").select("episode", "frame", F.lit(True).alias("forced")))
    return every.groupBy("episode", "frame").agg(F.max("forced").alias("forced"))


def plan_lines(units: DataFrame, level: int, lower: int) -> DataFrame:
    """(episode, plan, n_units): each unit with its lower units in brackets, in order of time."""
    parts = lambda x, name: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y[name]), ",")
    inner = links(units, level, lower).where("n_parents >= 1").groupBy("episode", F.col("l_id").alias("id")).agg(parts(F.struct("r_start", "r_end", F.col("r_id").alias("id"), F.col("r_id").cast("string").alias("name")), "name").alias("inner"))
    own = units.where(F.col("level") == level).join(inner, ["episode", "id"], "left")
    line = F.concat(F.col("id").cast("string"), F.lit("["), F.coalesce("inner", F.lit("")), F.lit("]"))
    lines = F.array_sort(F.collect_list(F.struct("start", "end", "id", line.alias("name"))))
    return own.groupBy("episode").agg(F.array_join(F.transform(lines, lambda y: y["name"]), " ").alias("plan"), F.count(F.lit(1)).alias("n_units"))


def holding(points: DataFrame, units: DataFrame, level: int, frame: str) -> DataFrame:
    """points with ``unit``: the first unit of the level that holds the frame, or null. points has episode and point."""
    at = points.select("episode", "point", F.col(frame).alias("l_start"), (F.col(frame) + 1).alias("l_end"))
    found = intervals.overlaps(at, _level(units, level, "r"), ["episode"], BIN).groupBy("episode", "point").agg(F.min_by("r_id", F.struct("r_start", "r_end")).alias("unit"))
    return points.join(found, ["episode", "point"], "left")


def targets(units: DataFrame, level: int, lower: int, frame: Column) -> DataFrame:
    """(episode, unit, frame, progress, following, lower_now, lower_next): for each unit of the level and its frame, the next unit, the lower unit at the frame and the first lower unit of the next."""
    by_time = Window.partitionBy("episode").orderBy("start", "end")
    own = units.where(F.col("level") == level)
    own = own.select("episode", F.col("id").alias("unit"), frame.alias("frame"), interval_progress(frame, F.col("start"), F.col("end")).alias("progress"), F.lead("id").over(by_time).alias("following"))
    children = links(units, level, lower).where("n_parents >= 1")
    first = children.groupBy("episode", F.col("l_id").alias("following")).agg(F.min_by("r_id", F.struct("r_start", "r_end")).alias("lower_next"))
    inside = children.select("episode", F.col("l_id").alias("unit"), "r_id", "r_start", "r_end")
    now = own.join(inside, ["episode", "unit"]).where("r_start <= frame and frame < r_end").groupBy("episode", "unit").agg(F.min_by("r_id", "r_start").alias("lower_now"))
    return own.join(now, ["episode", "unit"], "left").join(first, ["episode", "following"], "left")


def labelled(units: DataFrame, level: int, lower: int) -> DataFrame:
    """(episode, unit, lo, hi): the stretches of each unit that one of its lower units labels."""
    return links(units, level, lower).where("n_parents >= 1").select("episode", F.col("l_id").alias("unit"), F.col("r_start").alias("lo"), F.col("r_end").alias("hi"))


def quantile_frames(ranges: DataFrame, key: list[str], quantiles: list[float]) -> DataFrame:
    """(key, total, frame): the frames at floor(q * (total - 1)) of the ranges laid end to end, each once."""
    order = Window.partitionBy(*key).orderBy("lo")
    placed = ranges.withColumns({"before": F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy(*key))})
    at = [F.floor((F.col("total") - 1) * F.lit(q)) - F.col("before") for q in quantiles]
    inside = F.array_compact(F.array(*(F.when((x >= 0) & (x < F.col("hi") - F.col("lo")), F.col("lo") + x) for x in at)))
    return placed.select(*key, "total", F.explode(F.array_distinct(inside)).alias("frame"))


def image_refs(frame: Column, views: Column, stride: int = 10, most: int = 3) -> Column:
    """view@frame of the frames two strides back, one back and now, as far as they exist, each with the first views."""
    frames = F.filter(F.array(frame - 2 * stride, frame - stride, frame), lambda x: x >= 0)
    return F.flatten(F.transform(frames, lambda x: F.transform(F.slice(views, 1, most), lambda v: F.concat_ws("@", v, x))))


def capped(samples: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each key by order."""
    return samples.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= most).drop("__n")
