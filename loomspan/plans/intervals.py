"""Queries on intervals: orders and shipments by customer, events by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.times import day_number, seconds
from loomspan.operators import intervals
from loomspan.sources.tables import table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = day_number("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", start.alias("start"), (start + F.col("o_orderkey") % 60).alias("end"))


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", day_number("l_shipdate").alias("l_start"))
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return items.join(owner, "l_orderkey").withColumn("l_end", F.col("l_start") + F.col("l_linenumber"))


def _spans(spark: SparkSession, sf_dir: str, kind: str, side: str) -> DataFrame:
    start = seconds("ts")
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{side}_id"), start.alias(f"{side}_start"), (start + 3600 * (1 + F.col("event_id") % 24)).alias(f"{side}_end"))


def interval_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each order's interval breaks among its customer's."""
    return intervals.validate_intervals(_orders(spark, sf_dir), ["o_custkey"], "start", "end", F.lit(2400), 5, ["o_orderkey"])


def containment_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments that lie in an order's interval of the same customer: how many, and the first."""
    parents = _orders(spark, sf_dir).select("o_custkey", F.col("o_orderkey").alias("parent"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = intervals.contained(_shipments(spark, sf_dir), parents, ["o_custkey"], 60)
    return pairs.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n_parents"), F.min("parent").alias("first_parent"))


def range_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What views and clicks of a user share in time."""
    pairs = intervals.overlaps(_spans(spark, sf_dir, "view", "l"), _spans(spark, sf_dir, "click", "r"), ["user_id"], 86400)
    return pairs.select("user_id", "l_id", "r_id", "lo", "hi")


def max_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each view the click that it overlaps most."""
    return intervals.best_overlap(_spans(spark, sf_dir, "view", "l"), _spans(spark, sf_dir, "click", "r"), ["user_id"], "l_id", "r_id", 86400)


def asof_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view at or before each purchase."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    points = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return intervals.as_of(points, views, ["user_id"], "ts", "view_id").select("user_id", "event_id", "view_id")


def dense_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view that holds each purchase of a user, or stands for the one that is missing, and why."""
    points = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), seconds("ts").alias("at"))
    units = _spans(spark, sf_dir, "view", "u").where("user_id % 10 <> 3")
    return intervals.dense_units(points, units, ["user_id"], "purchase", "at", "u_id", "u_start", "u_end", 7200)


QUERIES = {f.__name__: f for f in (interval_validate, containment_link, range_intersect, max_overlap_join, asof_gap, dense_units)}

_ORDERS = "SELECT o_orderkey, o_custkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + o_orderkey % 60 AS e FROM orders"
_SPANS = "SELECT user_id, event_type, event_id AS id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 3600 * (1 + event_id % 24) AS e FROM events"
ORACLES = {
    "dense_units": f"""
        WITH p AS (SELECT user_id, id, s AS t FROM ({_SPANS}) WHERE event_type = 'purchase'), u AS (SELECT user_id, id, s, e FROM ({_SPANS}) WHERE event_type = 'view' AND user_id % 10 <> 3),
        j AS (SELECT p.user_id, p.id, t, count(u.id) FILTER (u.s <= t AND t < u.e) AS n, arg_min(u.id, (u.s, u.id)) FILTER (u.s <= t AND t < u.e) AS f, arg_max(u.id, (u.s, u.id)) FILTER (u.s <= t) AS l, arg_min(u.id, (u.s, u.id)) AS h FROM p LEFT JOIN u ON u.user_id = p.user_id GROUP BY ALL)
        SELECT user_id, id AS purchase, t AS "at", coalesce(f, l, h) AS u_id, n = 1 AS matched, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous_overlap_schema_proxy' WHEN h IS NOT NULL THEN 'unlabelled_gap_schema_proxy' END AS status FROM j""",
    "interval_validate": f"""
        WITH o AS ({_ORDERS}), p AS (SELECT *, lag(e) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS before FROM o)
        SELECT o_orderkey, o_custkey, s AS start, e AS "end",
               CASE WHEN e <= s THEN 'empty' WHEN s < 0 OR e > 2400 THEN 'out_of_range' WHEN e - s < 5 THEN 'short' WHEN s < before THEN 'overlap' ELSE 'ok' END AS reason
        FROM p""",
    "containment_link": f"""
        WITH o AS ({_ORDERS}), c AS (
          SELECT l_orderkey, l_linenumber, o_custkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_linenumber AS e
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT l_orderkey, l_linenumber, count(*) AS n_parents, min(o_orderkey) AS first_parent
        FROM c JOIN o ON c.o_custkey = o.o_custkey AND o.s <= c.s AND c.e <= o.e GROUP BY 1, 2""",
    "range_intersect": f"""
        WITH x AS ({_SPANS})
        SELECT l.user_id, l.id AS l_id, r.id AS r_id, greatest(l.s, r.s) AS lo, least(l.e, r.e) AS hi
        FROM x l JOIN x r ON l.user_id = r.user_id AND l.event_type = 'view' AND r.event_type = 'click' AND l.s < r.e AND r.s < l.e""",
    "max_overlap_join": f"""
        WITH x AS ({_SPANS}), p AS (
          SELECT l.user_id, l.id AS l_id, r.id AS r_id, least(l.e, r.e) - greatest(l.s, r.s) AS overlap,
                 row_number() OVER (PARTITION BY l.user_id, l.id ORDER BY least(l.e, r.e) - greatest(l.s, r.s) DESC, r.s, r.e, r.id) AS n
          FROM x l JOIN x r ON l.user_id = r.user_id AND l.event_type = 'view' AND r.event_type = 'click' AND l.s < r.e AND r.s < l.e)
        SELECT user_id, l_id, r_id, overlap FROM p WHERE n = 1""",
    "asof_gap": """
        WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
        SELECT p.user_id, p.event_id, v.view_id
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
}
