"""JSON lines: written in hash buckets, read with a schema, broken lines told apart."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.hashing import shard_of


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors see: spark.checkpoint.dir. Only a local session may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    return f"{folder or '/tmp/loomspan-checkpoints'}/{uuid.uuid4().hex}"


def write_buckets(df: DataFrame, key: Column, buckets: int, path: str) -> None:
    """A folder ``bucket=k`` for each bucket of the key's hash, with a JSON object a line; rows of a bucket are dealt over tasks, so no bucket has to fit in one."""
    df.withColumn("bucket", shard_of(key, buckets)).write.partitionBy("bucket").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all files below path, and ``broken``: the text of a line that is no object of the schema, with nulls beside it."""
    return spark.read.schema(f"{schema}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
