"""Queries on levels of intervals. Customers are episodes: their orders are units of level 1
(until the next order), two orders one of level 2, and the line items of an order share its
time as units of level 0. Some customers lack a level or have it out of step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.hashing import joined
from loomspan.functions.times import day_number
from loomspan.operators import hierarchy
from loomspan.sources.tables import table


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, level, id, start, end)."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("episode"), F.col("o_orderkey").alias("k"), day_number("o_orderdate").alias("s"))
    by_day = Window.partitionBy("episode").orderBy("s", "k")
    one = orders.withColumns({"t": F.coalesce(F.lead("s").over(by_day), F.col("s") + 30), "i": F.row_number().over(by_day) - 1})
    two = one.where("episode % 2 = 0").groupBy("episode", F.floor(F.col("i") / 2)).agg(F.min("k").alias("id"), F.min("s").alias("start"), F.max("t").alias("end"))
    line = Window.partitionBy("l_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(line.orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long").alias("r"), F.count(F.lit(1)).over(line).alias("c"))
    shift = F.when(F.col("episode") % 7 == 0, 1).otherwise(0)
    cut = lambda n: F.col("s") + F.expr(f"((t - s) * ({n})) div c") + shift
    # compressed columns are taken for the size of orders, which would be broadcast; lines are in order of their key
    zero = one.where("episode % 3 <> 0").hint("merge").join(lines, F.col("k") == F.col("l_orderkey")).select("episode", (F.col("k") * 10 + F.col("r")).alias("id"), cut("r - 1").alias("start"), cut("r").alias("end"))
    every = one.select("episode", F.lit(1).alias("level"), F.col("k").alias("id"), F.col("s").alias("start"), F.col("t").alias("end"))
    every = every.unionByName(two.select("episode", F.lit(2).alias("level"), "id", "start", "end")).unionByName(zero.select("episode", F.lit(0).alias("level"), "id", "start", "end"))
    return every.where("end > start")


def level_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of every unit of level 0 among those of level 1."""
    return hierarchy.links(units(spark, sf_dir), 1, 0).select("episode", F.col("r_id").alias("unit"), "n_parents", F.col("l_id").alias("parent"))


_LEFT = "NOT ({0} = 1 AND {1} % 11 = 4) AND NOT ({1} % 13 = 3 AND ({0} <> 1 OR id % 4 <> 0))"


def profile_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode's profile; some episodes have lost their units of level 1, some all but a few of them."""
    return hierarchy.profiles(units(spark, sf_dir).where(_LEFT.format("level", "episode")), {1: 3, 0: 3})


def level_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be told in the middle of every unit of level 1."""
    return hierarchy.targets(units(spark, sf_dir), 1, 0, F.expr("(start + end) div 2")).select("episode", "unit", "frame", "progress", "following", "lower_now", "lower_next")


def point_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit of level 2 that holds each order's day."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("episode"), F.col("o_orderkey").alias("point"), day_number("o_orderdate").alias("day"))
    return hierarchy.holding(orders, units(spark, sf_dir), 2, "day").select("point", "day", "unit")


def _gapped(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    return hierarchy.labelled((units(spark, sf_dir) if own is None else own).where("level = 1 or id % 3 <> 0"), 1, 0)


def labelled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each unit of level 1 that some unit of level 0 labels, a third of which are left out, and the days at three quantiles."""
    return hierarchy.quantile_frames(_gapped(spark, sf_dir), ["episode", "unit"], [0.25, 0.5, 0.75])


def image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and days that go with every order."""
    views = F.filter(F.array(*(F.when(F.expr(f"shiftright(o_custkey, {k}) & 1") == 1, v) for k, v in enumerate(("head", "left_wrist", "right_wrist", "side")))), lambda v: v.isNotNull())
    day = day_number("o_orderdate")
    refs = table(spark, sf_dir, "orders").select("o_orderkey", hierarchy.image_refs(day, views).alias("r"))
    return refs.select("o_orderkey", F.size("r").cast("long").alias("n_refs"), F.array_join("r", ",").alias("refs"))


def level_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five samples of an episode, in order of unit and day, with stable ids."""
    own = units(spark, sf_dir).where("level = 1").withColumn("unit_index", F.row_number().over(Window.partitionBy("episode").orderBy("start", "end")) - 1).select("episode", F.col("id").alias("unit"), "unit_index")
    frames = labelled_frames(spark, sf_dir).join(own, ["episode", "unit"])
    first = hierarchy.capped(frames, "episode", ["unit_index", "frame"], 5)
    key = F.concat(F.lit("v10-"), F.substring(F.sha2(joined(F.col("episode"), F.col("unit_index"), F.col("frame")), 256), 1, 20))
    return first.select("episode", F.col("unit_index").cast("long").alias("unit_index"), "frame", key.alias("sample_id"))


QUERIES = {f.__name__: f for f in (level_links, profile_choice, level_targets, point_unit, labelled_frames, image_refs, level_samples)}

_UNITS = """
    o AS (SELECT o_custkey AS e, o_orderkey AS k, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS s FROM orders),
    one AS (SELECT *, coalesce(lead(s) OVER w, s + 30) AS t, row_number() OVER w - 1 AS i FROM o WINDOW w AS (PARTITION BY e ORDER BY s, k)),
    n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem),
    u AS (SELECT * FROM (
        SELECT e, 1 AS lev, k AS id, s, t FROM one
        UNION ALL SELECT e, 2, min(k), min(s), max(t) FROM one WHERE e % 2 = 0 GROUP BY e, i // 2
        UNION ALL SELECT e, 0, k * 10 + r, s + ((t - s) * (r - 1)) // c + (e % 7 = 0)::INT, s + ((t - s) * r) // c + (e % 7 = 0)::INT FROM one JOIN n ON k = l_orderkey WHERE e % 3 <> 0) WHERE t > s)"""


def _links(a: int, b: int, units: str = "u") -> str:
    return f"""(SELECT c.e, c.id, any_value(c.s) AS s, any_value(c.t) AS t, count(p.id) AS np, arg_min(p.id, (p.s, p.id)) AS pid
        FROM {units} c LEFT JOIN {units} p ON p.e = c.e AND p.lev = {a} AND p.s <= c.s AND c.t <= p.t WHERE c.lev = {b} GROUP BY c.e, c.id)"""


def _nested(a: int, b: int) -> str:
    return f"(SELECT e, max((np <> 1)::INT) = 0 AND count(DISTINCT pid) FILTER (np = 1) = any_value(n) AS ok FROM {_links(a, b)} JOIN (SELECT e, count(*) AS n FROM u WHERE lev = {a} GROUP BY e) USING (e) GROUP BY e)"


_RANGES = f"""g AS (SELECT * FROM u WHERE lev = 1 OR id % 3 <> 0), r AS (SELECT e, pid AS unit, s AS lo, t AS hi FROM {_links(1, 0, "g")} WHERE np >= 1),
    p AS (SELECT *, coalesce(sum(hi - lo) OVER (PARTITION BY e, unit ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(hi - lo) OVER (PARTITION BY e, unit) AS total FROM r),
    f AS (SELECT DISTINCT e, unit, total::BIGINT AS total, (lo + floor(q * (total - 1)) - b)::BIGINT AS frame FROM p, (VALUES (0.25::DOUBLE), (0.5), (0.75)) v(q) WHERE floor(q * (total - 1)) - b >= 0 AND floor(q * (total - 1)) - b < hi - lo)"""

ORACLES = {
    "level_links": f"WITH {_UNITS} SELECT e AS episode, id AS unit, np AS n_parents, pid AS parent FROM {_links(1, 0)}",
    "profile_choice": f"""
        WITH {_UNITS.replace("u AS (SELECT * FROM (", "v AS (SELECT * FROM (")}, u AS (SELECT * FROM v WHERE {_LEFT.format("lev", "e")}), c AS (SELECT e, count(*) FILTER (lev = 2) AS n2, count(*) FILTER (lev = 1) AS n1, count(*) FILTER (lev = 0) AS n0 FROM u GROUP BY e),
        j AS (SELECT c.*, coalesce(x.ok, false) AS k21, coalesce(y.ok, false) AS k20, coalesce(z.ok, false) AS k10 FROM c LEFT JOIN {_nested(2, 1)} x USING (e) LEFT JOIN {_nested(2, 0)} y USING (e) LEFT JOIN {_nested(1, 0)} z USING (e))
        SELECT e AS episode, n2, n1, n0, CASE WHEN n2 > 0 AND n1 >= 3 AND n0 >= 3 AND k21 AND k10 THEN 'full' WHEN n2 > 0 AND n1 >= 3 AND k21 THEN 'L3L2L1' WHEN n2 > 0 AND n0 >= 3 AND k20 THEN 'L3L2L0'
            WHEN n2 > 0 THEN 'L3L2' WHEN n1 >= 3 AND n0 >= 3 AND k10 THEN 'L3L1L0' WHEN n1 >= 3 THEN 'L3L1' WHEN n0 >= 3 THEN 'L3L0' END AS profile FROM j""",
    "level_targets": f"""
        WITH {_UNITS}, a AS (SELECT e, id, s, t, (s + t) // 2 AS f, lead(id) OVER (PARTITION BY e ORDER BY s, t) AS nx FROM u WHERE lev = 1), l AS (SELECT * FROM {_links(1, 0)} WHERE np >= 1)
        SELECT e AS episode, id AS unit, f AS frame, round_even((f - s) / (t - s)::DOUBLE * 100, 0)::INT AS progress, nx AS following,
            (SELECT arg_min(l.id, l.s) FROM l WHERE l.e = a.e AND l.pid = a.id AND l.s <= f AND f < l.t) AS lower_now, (SELECT arg_min(l.id, (l.s, l.t)) FROM l WHERE l.e = a.e AND l.pid = nx) AS lower_next FROM a""",
    "point_unit": f"""
        WITH {_UNITS} SELECT o.k AS point, o.s AS day, arg_min(p.id, (p.s, p.t)) AS unit FROM o LEFT JOIN u p ON p.e = o.e AND p.lev = 2 AND p.s <= o.s AND o.s < p.t GROUP BY o.k, o.s""",
    "labelled_frames": f"WITH {_UNITS}, {_RANGES} SELECT e AS episode, unit, total, frame FROM f",
    "image_refs": """
        WITH d AS (SELECT o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS f,
            list_filter([CASE WHEN o_custkey & 1 = 1 THEN 'head' END, CASE WHEN o_custkey & 2 = 2 THEN 'left_wrist' END, CASE WHEN o_custkey & 4 = 4 THEN 'right_wrist' END, CASE WHEN o_custkey & 8 = 8 THEN 'side' END], lambda x: x IS NOT NULL)[1:3] AS v FROM orders),
        r AS (SELECT o_orderkey, flatten(list_transform(list_filter([f - 20, f - 10, f], lambda x: x >= 0), lambda x: list_transform(v, lambda y: y || '@' || x))) AS r FROM d)
        SELECT o_orderkey, len(r) AS n_refs, array_to_string(r, ',') AS refs FROM r""",
    "level_samples": f"""
        WITH {_UNITS}, {_RANGES}, x AS (SELECT e, id AS unit, row_number() OVER (PARTITION BY e ORDER BY s, t) - 1 AS i FROM u WHERE lev = 1),
        y AS (SELECT f.e, i, frame, row_number() OVER (PARTITION BY f.e ORDER BY i, frame) AS n FROM f JOIN x ON x.e = f.e AND x.unit = f.unit)
        SELECT e AS episode, i AS unit_index, frame, 'v10-' || substr(sha256(e || chr(0) || i || chr(0) || frame), 1, 20) AS sample_id FROM y WHERE n <= 5""",
}
