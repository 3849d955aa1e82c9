"""Hash splits and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.hashing import joined, shard_of, unit_interval
from loomspan.sources.tables import table


def stable_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split by the hash of (seed, id); statistics of each side."""
    docs = table(spark, sf_dir, "documents")
    side = F.when(unit_interval(joined("42", F.col("doc_id"))) < 0.2, "val").otherwise("train")
    return docs.groupBy(side.alias("split")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("sum_chars"), F.min("doc_id").alias("min_doc_id"))


def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and users of each of 16 hash shards of the events."""
    events = table(spark, sf_dir, "events")
    shard = shard_of(F.col("user_id").cast("string"), 16)
    return events.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_users"))


QUERIES = {"stable_split": stable_split, "shard_assign": shard_assign}
ORACLES = {
    "stable_split": """
        SELECT CASE WHEN ('0x' || substr(sha256('42' || chr(0) || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.2 THEN 'val' ELSE 'train' END AS split,
               count(*) AS n_docs, sum(n_chars)::BIGINT AS sum_chars, min(doc_id) AS min_doc_id
        FROM documents GROUP BY 1""",
    "shard_assign": """
        SELECT (('0x' || substr(sha256(user_id::VARCHAR), 1, 16))::UBIGINT % 16)::INT AS shard, count(*) AS n_events, count(DISTINCT user_id) AS n_users
        FROM events GROUP BY 1""",
}
