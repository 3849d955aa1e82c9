"""Queries on catalogs: pairs, failing paths, counters, manifests, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import catalogs
from loomspan.sources.tables import table


def selected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that some returned line chose."""
    chosen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalogs.selected(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), chosen, ["o_orderkey"])


def ordered_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders with their places in order of key."""
    return catalogs.in_order(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", "F")


_VARIANT = "CASE WHEN l_linenumber % 2 = 0 THEN 'no_memory' ELSE 'with_memory' END"
_PRINT = "CASE WHEN l_orderkey % 3 = 0 THEN l_returnflag WHEN l_orderkey % 7 <> 0 THEN 'same' END"


def broken_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose first lines aren't a pair of variants with one fingerprint."""
    own = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").selectExpr("l_orderkey", f"{_VARIANT} AS variant", f"{_PRINT} AS print")
    return catalogs.broken_pairs(own, "l_orderkey", "variant", "print")


def path_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the parts' paths fail, among events that are errors."""
    own = table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("concat('/p/', user_id % 20) AS path", "user_id AS episode", "concat('s', event_id % 3) AS source", "concat('e', event_id % 4) AS error")
    return catalogs.path_statistics(own, "path", "episode", "source", "error")


def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the events of three runs, merged."""
    events = table(spark, sf_dir, "events")
    one = lambda k: catalogs.counters(events.where(F.col("user_id") % 3 == k), {"samples": F.col("event_id") % 5, "failed": (F.col("event_type") == "error").cast("int")}, {"by_type": F.col("event_type"), "by_hour": F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 24)})
    return catalogs.merged(*(one(k) for k in range(3)))


def manifest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as a manifest by market segment: repeated keys, and what is ready."""
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_mktsegment"), "o_custkey")
    return catalogs.manifest_report(own, "o_orderdate", "c_mktsegment", F.col("o_orderstatus") != "P", F.col("o_orderkey") % 4)


def topic_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of the orders as episodes, by key and by topic."""
    shard = lambda way: catalogs.inventory_shard(way, F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.concat(F.lit("/t/"), F.col("o_custkey")), 16)
    return table(spark, sf_dir, "orders").select("o_orderkey", shard("episode").alias("by_episode"), shard("topic").alias("by_topic"))


def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, reasons and falls of progress of each user's events as a run."""
    return catalogs.run_rollup(table(spark, sf_dir, "events").withColumn("reason", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("r"), F.col("event_id") % 3))), ["user_id"], ["ts", "event_id"], F.col("event_type"), "value", "reason")


QUERIES = {f.__name__: f for f in (selected_items, ordered_catalog, broken_pairs, path_statistics, merged_counters, manifest_report, topic_shards, run_rollup)}
ORACLES = {
    "selected_items": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)",
    "ordered_catalog": "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders WHERE o_orderstatus = 'F'",
    "broken_pairs": f"""
        WITH s AS (SELECT l_orderkey, {_VARIANT} AS v, {_PRINT} AS p FROM lineitem WHERE l_linenumber <= 3)
        SELECT l_orderkey, count(*) AS n, count(DISTINCT p) = 1 AS alike, count(*) FILTER (v = 'no_memory') AS first, count(*) FILTER (v = 'with_memory') AS second, greatest(count(*) FILTER (v = 'no_memory'), count(*) FILTER (v = 'with_memory')) > 1 AS repeated
        FROM s GROUP BY 1 HAVING count(*) <> 2 OR count(DISTINCT p) <> 1 OR count(*) FILTER (v = 'no_memory') <> 1 OR count(*) FILTER (v = 'with_memory') <> 1""",
    "path_statistics": """
        WITH f AS (SELECT '/p/' || user_id % 20 AS path, user_id AS e, 's' || event_id % 3 AS s, 'e' || event_id % 4 AS k FROM events WHERE event_type = 'error'), k AS (SELECT path, k, count(*) AS c FROM f GROUP BY ALL), t AS (SELECT path, string_agg(k || ':' || c, ',' ORDER BY c DESC, k) AS kinds FROM k GROUP BY 1)
        SELECT path, count(*) AS errors, count(DISTINCT e) AS episodes, string_agg(DISTINCT s, ',' ORDER BY s) AS sources, any_value(kinds) AS kinds, array_to_string(list_sort(list(DISTINCT e))[:3], ',') AS representatives FROM f JOIN t USING (path) GROUP BY 1""",
    "merged_counters": """
        SELECT 'samples' AS counter, '' AS name, sum(event_id % 5)::BIGINT AS n FROM events UNION ALL SELECT 'failed', '', count(*) FILTER (event_type = 'error') FROM events UNION ALL SELECT 'by_type', event_type, count(*) FROM events GROUP BY ALL
        UNION ALL SELECT 'by_hour', (event_id % 24)::VARCHAR, count(*) FROM events WHERE event_id % 2 = 0 GROUP BY ALL""",
    "manifest_report": """
        WITH o AS (SELECT o_orderdate AS k, c_mktsegment AS g, o_orderstatus <> 'P' AS r, o_orderkey % 4 AS v FROM orders JOIN customer ON c_custkey = o_custkey), c AS (SELECT g, k, count(*) AS c, count(*) FILTER (r) AS r, sum(v) AS v FROM o GROUP BY ALL),
        s AS (SELECT g AS "group", sum(c)::BIGINT AS episodes, count(*) AS "distinct", count(*) FILTER (c > 1) AS repeated, sum(r)::BIGINT AS ready, sum(v)::BIGINT AS views FROM c GROUP BY 1)
        SELECT *, ready = episodes AND repeated = 0 AS release_ready FROM (FROM s UNION ALL SELECT NULL, sum(episodes)::BIGINT, sum("distinct")::BIGINT, sum(repeated)::BIGINT, sum(ready)::BIGINT, sum(views)::BIGINT FROM s)""",
    "topic_shards": """
        SELECT o_orderkey, (('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 16))::UBIGINT % 16)::INT AS by_episode, (('0x' || substr(sha256(o_orderstatus || chr(0) || '/t/' || o_custkey), 1, 16))::UBIGINT % 16)::INT AS by_topic FROM orders""",
    "run_rollup": """
        WITH e AS (SELECT user_id, event_type, CASE WHEN event_id % 3 <> 0 THEN 'r' || event_id % 3 END AS reason, (value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS fell FROM events)
        SELECT user_id, 'class' AS section, event_type AS name, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT user_id, 'reason', reason, count(*) FROM e WHERE reason IS NOT NULL GROUP BY ALL UNION ALL SELECT user_id, 'regressions', '', sum(coalesce(fell, 0))::BIGINT FROM e GROUP BY ALL""",
}
