"""Queries that SQL can't express: sequential packing, the event memory, captions that are alike, the stratified split. Tests hold them against plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.times import micros
from loomspan.operators import nearest, split
from loomspan.operators.packing import best_fit_bins
from loomspan.sources.tables import table
from loomspan.streaming.memory import batch_memory


def observations(events: DataFrame) -> DataFrame:
    """Events as observations: the type as caption, the value up to 100 as progress."""
    progress = F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(100.0)).cast("int")
    return events.select(F.col("user_id").cast("string").alias("key"), micros("ts").alias("at"), F.col("event_type").alias("caption"), progress.alias("progress"), F.lit("").alias("following"))


def knapsack_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed by characters into bins of 20,000."""
    return best_fit_bins(table(spark, sf_dir, "documents"), "doc_id", "n_chars", 20_000)


def memory_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory of each user after each event."""
    return batch_memory(observations(table(spark, sf_dir, "events")))


def known_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the names of known states, which stand for what is alike: plurals, other endings, a word more."""
    said = F.expr("CASE event_id % 4 WHEN 0 THEN event_type || 's' WHEN 1 THEN 'the ' || event_type WHEN 2 THEN upper(event_type) || '.' ELSE event_type END")
    own = observations(table(spark, sf_dir, "events")).withColumn("known", F.array(*(F.lit(c) for c in ("purchase", "signup", "view", "the click"))))
    ids = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), micros("ts").alias("at"), F.col("event_type").alias("caption"), said.alias("said"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"))
    return batch_memory(own.join(ids, ["key", "at", "caption"]).select("key", "at", F.col("said").alias("caption"), "progress", F.col("next").alias("following"), "known"))


def nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part's name that is most alike, for each name with changes."""
    parts = table(spark, sf_dir, "part")
    changed = F.expr("CASE p_partkey % 5 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN p_name || 's' WHEN 2 THEN substring(p_name, 2) WHEN 3 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) ELSE 'x' || p_partkey END")
    return nearest.nearest_captions(parts.select("p_partkey", changed.alias("caption")), "caption", parts, "p_name").select("p_partkey", "caption", "nearest", F.round("likeness", 9).alias("likeness"))


def stratified_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers split by the priorities of their orders, their nation and how many orders they have."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.substring("o_orderpriority", 1, 1))).alias("classes"), F.count(F.lit(1)).alias("n"))
    own = orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    size = F.when(F.col("n") <= 1, "1").when(F.col("n") <= 3, "2-3").when(F.col("n") <= 7, "4-7").otherwise("8+")
    return split.stratified_split(own.withColumns({"classes": F.slice("classes", 1, 2), "size": size}), "o_custkey", "classes", "c_nationkey", "size", "n").select("o_custkey", "test")


QUERIES = {f.__name__: f for f in (knapsack_bins, memory_bank, known_memory, nearest_names, stratified_customers)}
ORACLES: dict[str, str] = {}
