"""Catalogs of episodes and samples: pairs, paths that fail, counters of partial runs, manifests, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.hashing import joined, shard_of
from loomspan.operators.ranking import global_rank

VARIANTS = ("no_memory", "with_memory")


def selected(inventory: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    """Rows of an inventory whose key was chosen, each once however often."""
    return inventory.join(chosen.select(*key).distinct(), key, "left_semi")


def in_order(catalog: DataFrame, key: str, status: str | None = None, value: str | None = None) -> DataFrame:
    """Rows (of one status, if it is given) and ``place``, from 0 by key; the order is that of a range partitioning."""
    own = catalog if status is None else catalog.where(F.col(status) == value)
    return global_rank(own, [key])[0].withColumnRenamed("rank", "place")


def broken_pairs(samples: DataFrame, base: str, variant: str, fingerprint: str) -> DataFrame:
    """(base, n, fingerprints, first, second, repeated) of the bases that aren't one row of each variant with the same fingerprint; repeated: whether a variant comes twice."""
    one = samples.groupBy(base, variant).agg(F.count(F.lit(1)).alias("c"), F.min(fingerprint).alias("lo"), F.max(fingerprint).alias("hi"))
    count = lambda v: F.coalesce(F.sum(F.when(F.col(variant) == v, F.col("c"))), F.lit(0))
    own = one.groupBy(base).agg(F.sum("c").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("lo").alias("known"), count(VARIANTS[0]).alias("first"), count(VARIANTS[1]).alias("second"), (F.max("c") > 1).alias("repeated"))
    alike = (F.col("known") > 0) & (F.col("lo") == F.col("hi"))
    return own.where(~((F.col("n") == 2) & F.coalesce(alike, F.lit(False)) & (F.col("first") == 1) & (F.col("second") == 1))).select(base, "n", F.coalesce(alike, F.lit(False)).alias("alike"), "first", "second", "repeated")


def path_statistics(failures: DataFrame, path: str, episode: str, source: str, error: str, kept: int = 3) -> DataFrame:
    """(path, errors, episodes, sources, kinds, representatives): how often each path fails, in how many episodes and sources, by which errors (most first, ties by name) and the least few episodes."""
    episodes = failures.groupBy(path, episode).agg(F.count(F.lit(1)).alias("n"))
    first = episodes.withColumn("k", F.row_number().over(Window.partitionBy(path).orderBy(episode))).where(F.col("k") <= kept).groupBy(path).agg(F.array_join(F.array_sort(F.collect_list(episode)), ",").alias("representatives"))
    sums = episodes.groupBy(path).agg(F.sum("n").alias("errors"), F.count(F.lit(1)).alias("episodes"))
    # kinds of errors and sources are few
    kinds = failures.groupBy(path, error).agg(F.count(F.lit(1)).alias("c")).groupBy(path).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col(error).alias("e")))), lambda x: F.concat_ws(":", x["e"], -x["c"])), ",").alias("kinds"))
    sources = failures.groupBy(path).agg(F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))
    return sums.join(sources, path).join(kinds, path).join(first, path).select(path, "errors", "episodes", "sources", "kinds", "representatives")


def counters(df: DataFrame, scalars: dict[str, Column], grouped: dict[str, Column]) -> DataFrame:
    """(counter, name, n) of a run: sums of whole-number columns, with an empty name, and rows by the values of others; nulls count nowhere."""
    parts = [F.struct(F.lit(k).alias("counter"), F.lit("").alias("name"), F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias("n")) for k, c in scalars.items()]
    parts += [F.when(c.isNotNull(), F.struct(F.lit(k).alias("counter"), c.cast("string").alias("name"), F.lit(1).cast("long").alias("n"))) for k, c in grouped.items()]
    return merged(df.select(F.explode(F.array_compact(F.array(*parts))).alias("p")).select("p.*"))


def merged(*partials: DataFrame) -> DataFrame:
    """Counters of several runs as one: sums in any order."""
    return reduce(DataFrame.unionByName, partials).groupBy("counter", "name").agg(F.sum("n").alias("n"))


def manifest_report(rows: DataFrame, key: str, group: str, ready: Column, views: Column) -> DataFrame:
    """(group, episodes, distinct, repeated, ready, views, release_ready): per group and, with a null group, in all: episodes, distinct keys, keys that come again, episodes with everything, how many views they declare in all, and whether every one is ready and comes once."""
    one = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), ready.alias("r"), views.alias("v")).groupBy("group", "key").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.coalesce("r", F.lit(False))).alias("r"), F.sum("v").alias("v"))
    sums = one.groupBy("group").agg(F.sum("c").alias("episodes"), F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("c") > 1).alias("repeated"), F.sum("r").alias("ready"), F.sum("v").alias("views"))
    whole = sums.agg(*(F.sum(c).alias(c) for c in ("episodes", "distinct", "repeated", "ready", "views"))).where("episodes > 0").withColumn("group", F.lit(None).cast(sums.schema["group"].dataType))
    return sums.unionByName(whole).withColumn("release_ready", (F.col("ready") == F.col("episodes")) & (F.col("repeated") == 0))


def inventory_shard(strategy: str, episode: Column, source: Column, topic: Column, shards: int) -> Column:
    """The shard of an inventory's row: by episode, or by source and topic, so that what shares an annotation is read together."""
    if strategy not in ("episode", "topic"):
        raise ValueError(f"no such strategy: {strategy}")
    return shard_of(episode if strategy == "episode" else joined(source, topic), shards)


def run_rollup(df: DataFrame, run: list[str], order: list[str], kind: Column, progress: str, reason: str) -> DataFrame:
    """(run, section, name, n): a run's outputs by class, its memory's reasons, and how often its progress falls from one row to the next."""
    by_time = Window.partitionBy(*run).orderBy(*order)
    own = df.withColumns({"__kind": kind, "__fell": (F.col(progress) < F.lag(progress).over(by_time)).cast("long")})
    row = lambda section, name, n: F.struct(F.lit(section).alias("section"), name.cast("string").alias("name"), n.cast("long").alias("n"))
    parts = F.array(row("class", F.col("__kind"), F.lit(1)), row("reason", F.col(reason), F.lit(1)), row("regressions", F.lit(""), F.coalesce("__fell", F.lit(0))))
    return own.select(*run, F.explode(parts).alias("p")).select(*run, "p.*").where("name is not null").groupBy(*run, "section", "name").agg(F.sum("n").alias("n"))
