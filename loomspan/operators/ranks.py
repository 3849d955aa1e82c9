"""Bins dealt to the workers of a training run, lengths kept between runs, and bins' rows laid end to end."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.ranking import global_rank


def dealt_bins(bins: DataFrame, bin_id: str, workers: int, seed: int, epoch: int = 0) -> DataFrame:
    """(bin, step, rank, again): every bin's worker and step in one epoch.

    Bins are put in an order that seed, epoch and the bin's hash decide, by a range
    partitioning and not by one task's sort. The first ones come again at the end until
    all workers have as many steps (several times, if there are fewer bins than workers);
    places are dealt to workers in turn. No bin gives no rows.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(bin_id).cast("string")), 256)
    ranked, n = global_rank(bins.select(F.col(bin_id).alias("bin"), key.alias("__order")), ["__order", "bin"])
    total = -(-n // workers) * workers
    times = F.floor((F.lit(total - 1) - F.col("rank")) / max(n, 1))
    places = ranked.select("bin", "rank", F.explode(F.sequence(F.lit(0).cast("long"), times)).alias("turn")).withColumn("place", F.col("rank") + F.col("turn") * n)
    return places.select("bin", F.floor(F.col("place") / workers).alias("step"), (F.col("place") % workers).alias("rank"), (F.col("turn") > 0).alias("again"))


def config_hash(config: dict) -> str:
    """16 hex digits of settings, whatever their order."""
    return sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def cached_lengths(df: DataFrame, item: str, length: Column, config: dict, folder: str) -> DataFrame:
    """(item, length) as the settings' folder has it, made where it is missing; -1 where the length is null, negative or can't be told.

    The folder is named by the hash of the settings; it counts as whole when its writer's
    mark is there, so a run that broke off is done again.
    """
    spark, path = df.sparkSession, f"{folder}/{config_hash(config)}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        known = F.when(length >= 0, length).otherwise(-1)
        df.select(F.col(item).alias("item"), known.cast("long").alias("length")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def length_report(lengths: DataFrame) -> DataFrame:
    """(n, failed, total) of cached lengths: counts, and the sum of those that are known."""
    bad = F.col("length") < 0
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("failed"), F.coalesce(F.sum(F.when(~bad, F.col("length"))), F.lit(0)).alias("total"))


def length_failures(lengths: DataFrame, kept: int = 20) -> DataFrame:
    """The least few items whose length can't be told."""
    return lengths.where("length < 0").select("item").orderBy("item").limit(kept)


def packed_rows(items: DataFrame, bin_id: str, order: list[str], tokens: str, capacity: int, pad: int | None = None) -> DataFrame:
    """(bin, tokens, ends, real): the token arrays of each bin end to end, where each item ends, and how many tokens are real.

    A bin holds at most capacity tokens by how it was made; with pad its row is filled up
    to capacity with that token. Items without tokens have an end of their own.
    """
    own = items.groupBy(bin_id).agg(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(tokens, F.array().cast(items.schema[tokens].dataType)).alias("__t")))).alias("__i"))
    flat = F.flatten(F.transform("__i", lambda x: x["__t"]))
    ends = F.aggregate(F.transform("__i", lambda x: F.size(x["__t"])), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    filled = flat if pad is None else F.concat(flat, F.array_repeat(F.lit(pad).cast(items.schema[tokens].dataType.elementType), F.greatest(capacity - F.size(flat), F.lit(0))))
    return own.select(F.col(bin_id).alias("bin"), filled.alias("tokens"), ends.alias("ends"), F.size(flat).alias("real"))
