"""Deduplication by precedence, checked unions, upserts, fences and completeness.

All but ``fence`` are one aggregation with partial sums before its shuffle, so groups of
any size cost no more than their distinct keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import bound

#: Passages up to which their hashes go to all tasks: some megabytes. More are joined by a shuffle.
_FEW = 100_000


def first_of(df: DataFrame, key: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """For each key, the columns ``keep`` of the first row by order, and the number of rows, ``copies``."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("kept"), F.count(F.lit(1)).alias("copies")).select(*key, "kept.*", "copies")


def last_of(df: DataFrame, key: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """As first_of, with the last row by order."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("kept"), F.count(F.lit(1)).alias("copies")).select(*key, "kept.*", "copies")


def checked_union(parts: list[DataFrame], key: str, fingerprint: Column) -> DataFrame:
    """(key, copies, conflict): rows of a key in all parts, and whether their fingerprints differ."""
    both = None
    for part in parts:
        one = part.select(key, fingerprint.alias("__print"))
        both = one if both is None else both.unionByName(one)
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), (F.min("__print") != F.max("__print")).alias("conflict"))


def replace_groups(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """base with the groups that delta has replaced by delta's rows."""
    return base.join(delta.select(key).distinct(), key, "left_anti").unionByName(delta)


def fence(df: DataFrame, held: DataFrame, modes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """df and ``match``: the first mode by which a row equals one of held, or null.

    Each mode is an equality of (expression on df, expression on held): one hash join
    each, never an OR in a join. A null matches nothing.
    """
    # all keys come before the first join, so that columns only they need don't go through it
    out = df.withColumns({f"__k{i}": own for i, (own, _) in enumerate(modes.values())})
    for i, (_, other) in enumerate(modes.values()):
        keys = held.select(other.alias(f"__k{i}")).where(F.col(f"__k{i}").isNotNull()).distinct().withColumn(f"__m{i}", F.lit(True))
        out = out.join(keys, f"__k{i}", "left")
    first = F.coalesce(*(F.when(F.col(f"__m{i}"), name) for i, name in enumerate(modes)))
    return out.withColumn("match", first).drop(*(f"__{x}{i}" for i in range(len(modes)) for x in "km"))


def holdings(df: DataFrame, key: str, body: Column, held: DataFrame, item: str, passage: Column, least: int = 8) -> DataFrame:
    """(key, item): every row key of df whose body has an item's passage anywhere in it, word for word; both are words with single spaces.

    The first words of a passage, at most ``least`` of them, meet the same number of words
    from every place of a body by equality of hashes; what meets is checked in full.
    """
    items = held.select(item, passage.alias("__p")).where(F.col(item).isNotNull() & (F.col("__p") != "")).distinct()
    items = items.withColumn("__n", F.least(F.size(F.split("__p", " ")), F.lit(least)))
    first = lambda words, at, n: F.xxhash64(F.array_join(F.slice(words, at, n), " "))
    items = items.withColumn("__k", first(F.split("__p", " "), F.lit(1), F.col("__n")))
    counted = items.groupBy("__n").count().collect()  # at most ``least``
    lengths, few = [r[0] for r in counted], sum(r[1] for r in counted) <= _FEW
    bodies = df.select(key, body.alias("__b")).where(F.col(key).isNotNull() & (F.col("__b") != ""))
    places = lambda words, n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda at: first(words, at, n)))
    empty = F.array().cast("array<bigint>")
    # a body is split once for all its places
    every = bound(F.split("__b", " "), lambda words: F.array_distinct(F.concat(empty, *(F.coalesce(places(words, n), empty) for n in lengths))))
    known = items.select(item, "__k")
    found = bodies.select(key, F.explode(every).alias("__k")).join(F.broadcast(known) if few else known, "__k").select(key, item).distinct()
    full = found.join(bodies, key).join(items.select(item, "__p"), item)
    return full.where(F.contains(F.concat(F.lit(" "), "__b", F.lit(" ")), F.concat(F.lit(" "), "__p", F.lit(" ")))).select(key, item).distinct()


def gapless(df: DataFrame, key: str, index: str) -> DataFrame:
    """(key, n_index, complete): whether a key's distinct indices are 0, 1, ... without a gap."""
    once = df.where(F.col(index).isNotNull()).groupBy(key, index).agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy(key).agg(F.count(F.lit(1)).alias("n_index"), ((F.min(index) == 0) & (F.max(index) + 1 == F.count(F.lit(1)))).alias("complete"))


def remap_longest(df: DataFrame, key: str, path: str, maps: DataFrame) -> DataFrame:
    """(key, path): the longest prefix of maps (prefix, target) that ends at a slash or the path's end, replaced by its target.

    A path meets the map by equality with each of its own prefixes, so the map can be of any size.
    """
    cuts = F.transform(F.sequence(F.lit(0), F.size(F.split(path, "/"))), lambda n: F.array_join(F.slice(F.split(path, "/"), 1, n), "/"))
    tried = df.select(key, path, F.explode(F.array_distinct(cuts)).alias("prefix"))
    longest = tried.join(maps, "prefix", "left").groupBy(key, path).agg(F.max_by(F.struct("prefix", "target"), F.when(F.col("target").isNotNull(), F.length("prefix"))).alias("m"))
    return longest.select(key, F.coalesce(F.concat("m.target", F.expr(f"substring({path}, length(m.prefix) + 1)")), F.col(path)).alias(path))


def unique_partition(df: DataFrame, key: str, part: str) -> DataFrame:
    """(key, n_parts): keys that stand in more than one part."""
    once = df.groupBy(key, part).agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy(key).agg(F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1")


def unmatched(df: DataFrame, key: str, parents: DataFrame, parent: str) -> DataFrame:
    """Rows of df whose key is no parent: a foreign key that fails. Null keys fail."""
    return df.join(parents.select(F.col(parent).alias(key)).distinct(), key, "left_anti")


def first_candidate(df: DataFrame, row: str, candidates: Column, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """(row, key, value): for each row, the first of its candidate keys that lookup has."""
    tried = df.select(row, F.posexplode(candidates).alias("__at", key)).join(lookup.select(key, value), key)
    return tried.groupBy(row).agg(F.min_by(F.struct(key, value), F.struct("__at", key, value)).alias("x")).select(row, "x.*")


def collected(df: DataFrame, key: list[str], index: str, value: Column, normal: Column, order: list[str]) -> DataFrame:
    """(key, index, value, conflict): the first value by order of each index, and whether the normalised values differ; any order of arrival gives the same."""
    own = df.select(*key, index, value.alias("__v"), normal.alias("__n"), F.struct(*order).alias("__o"))
    return own.groupBy(*key, index).agg(F.min_by("__v", "__o").alias("value"), (F.min("__n") != F.max("__n")).alias("conflict"))


def differences(left: DataFrame, right: DataFrame, key: list[str], fingerprint: Column) -> DataFrame:
    """(key, side): keys with a fingerprint that only one of two tables has; empty when both hold the same."""
    own = left.select(*key, fingerprint.alias("__p")).withColumn("__s", F.lit(1)).unionByName(right.select(*key, fingerprint.alias("__p")).withColumn("__s", F.lit(2)))
    return own.groupBy(*key, "__p").agg(F.min("__s").alias("lo"), F.max("__s").alias("hi")).where("lo = hi").select(*key, F.when(F.col("lo") == 1, "left").otherwise("right").alias("side"))


def duplicate_ids(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, copies): keys that come more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
