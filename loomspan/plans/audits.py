"""Queries on keys between tables: partitions, foreign keys, fallback keys, equality, pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import hashing, text
from loomspan.operators import merging
from loomspan.sources.tables import table


def shared_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders stand in several of 16 parts."""
    return merging.unique_partition(table(spark, sf_dir, "orders").withColumn("part", F.col("o_orderkey") % 16), "o_custkey", "part")


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers with a negative balance, as orders without a customer in good standing."""
    good = table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return merging.unmatched(table(spark, sf_dir, "orders"), "o_custkey", good, "c_custkey").select("o_orderkey", "o_custkey")


def fallback_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer that each order's candidate keys find first: its own tenfold, one of three, or its own."""
    orders = table(spark, sf_dir, "orders")
    candidates = F.array(F.col("o_custkey") * 10, F.when(F.col("o_custkey") % 3 == 0, F.expr("o_custkey div 3")), F.col("o_custkey"))
    return merging.first_candidate(orders, "o_orderkey", candidates, table(spark, sf_dir, "customer"), "c_custkey", "c_name")


def partial_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role first said at each place of four in a conversation, and whether others differ."""
    said = table(spark, sf_dir, "conversations").withColumn("place", F.expr("turn % 4"))
    return merging.collected(said, ["conv_id"], "place", F.col("role"), text.normalised(F.col("role")), ["turn"])


def table_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that one of two states has, or has otherwise."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey") % 7)
    later = orders.where("o_orderkey % 9 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return merging.differences(orders, later, ["o_orderkey"], F.col("o_orderstatus"))


def pending_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without any order that is done, still to be worked on."""
    return merging.unmatched(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 300000"), "o_custkey")


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts that come together in several line items."""
    return merging.duplicate_ids(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


def replaced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with those of every tenth order replaced by one row, counted by order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    delta = lines.where("l_orderkey % 10 = 0").select("l_orderkey", F.lit(99).alias("l_linenumber")).distinct()
    return merging.replace_groups(lines, delta, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("most"))


def stable_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds and digests of parts, each part ended by NUL."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    whole = hashing.terminated(F.col("p_brand"), F.col("p_size"))
    return parts.select("p_partkey", F.sha2(whole, 256).alias("digest"), F.pmod(hashing.hash64(whole), F.lit(1000003).cast("decimal(20,0)")).cast("long").alias("seed"))


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each user: accepted rows without reason, rejected ones with a detail of at most 40 characters."""
    events = table(spark, sf_dir, "events")
    last = merging.last_of(events, ["user_id"], [F.col("ts"), F.col("event_id")], ["event_type", "props", "event_id"])
    bad = F.col("event_type") == "error"
    return last.select("user_id", F.when(bad, "rejected").otherwise("accepted").alias("status"), F.when(bad, F.substring(F.repeat("props", 5), 1, 40)).alias("detail"), F.when(~bad, F.col("event_id")).alias("sample"))


QUERIES = {f.__name__: f for f in (shared_partitions, foreign_keys, fallback_keys, partial_plans, table_differences, pending_keys, duplicate_ids, replaced_groups, stable_seeds, rejected_rows)}
ORACLES = {
    "shared_partitions": "SELECT o_custkey, count(DISTINCT o_orderkey % 16) AS n_parts FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 16) > 1",
    "foreign_keys": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "fallback_keys": """
        WITH t AS (SELECT o_orderkey, 0 AS nth, o_custkey * 10 AS c_custkey FROM orders UNION ALL SELECT o_orderkey, 1, o_custkey // 3 FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT o_orderkey, 2, o_custkey FROM orders)
        SELECT o_orderkey, arg_min(c_custkey, nth) AS c_custkey, arg_min(c_name, nth) AS c_name FROM t JOIN customer USING (c_custkey) GROUP BY 1""",
    "partial_plans": "SELECT conv_id, turn % 4 AS place, arg_min(role, turn) AS value, count(DISTINCT lower(role)) > 1 AS conflict FROM conversations GROUP BY 1, 2",
    "table_differences": """
        WITH l AS (SELECT o_orderkey, o_orderstatus FROM orders), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 9 <> 0)
        SELECT o_orderkey, 'left' AS side FROM (FROM l EXCEPT FROM r) UNION ALL SELECT o_orderkey, 'right' FROM (FROM r EXCEPT FROM l)""",
    "pending_keys": "SELECT c_custkey FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)",
    "duplicate_ids": "SELECT l_partkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "replaced_groups": "SELECT l_orderkey, CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE count(*) END AS n, CASE WHEN l_orderkey % 10 = 0 THEN 99 ELSE max(l_linenumber) END AS most FROM lineitem GROUP BY 1",
    "stable_seeds": """
        WITH d AS (SELECT p_partkey, sha256(p_brand || chr(0) || p_size || chr(0)) AS digest FROM part)
        SELECT p_partkey, digest, (('0x' || substr(digest, 1, 16))::UBIGINT % 1000003)::BIGINT AS seed FROM d""",
    "rejected_rows": """
        WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(props, (ts, event_id)) AS props, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1)
        SELECT user_id, CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN event_type = 'error' THEN substr(repeat(props, 5), 1, 40) END AS detail, CASE WHEN event_type <> 'error' THEN event_id END AS sample FROM l""",
}
