"""Digests of tables that don't depend on the order or the partitions of their rows, and snapshots made of such tables.

A row's hash is of its values with their lengths, so no two rows read alike. A table's
digest is made of the number of rows and, of two 60-bit halves of the rows' hashes, the
exclusive or and the sum: all combine in any order, and rows that come twice don't
vanish, as they would from the exclusive or alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's values as text with their lengths; nulls have a mark of their own."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, columns)), 256)


def table_digest(df: DataFrame, columns: list[str], group: list[str] | None = None, *more: Column) -> DataFrame:
    """(group, n, digest) of the rows of each group, or of all: one row, for an empty table as well if there is no group. more are aggregates beside them."""
    half = lambda k: F.conv(F.substring("__h", k, 15), 16, 10).cast("bigint")
    halves = {"__a": half(1), "__b": half(16)}
    own = df.withColumn("__h", row_hash(columns)).withColumns(halves).groupBy(*(group or []))
    folded = own.agg(F.count(F.lit(1)).alias("n"), *(f.alias(f"{c}{k}") for c in halves for k, f in (("x", F.bit_xor(c)), ("s", F.sum(F.col(c).cast("decimal(38,0)"))))), *more)
    kept = [c for c in folded.columns if c not in (group or []) and c != "n" and not c.startswith("__")]
    text = F.concat_ws("|", "n", *(F.coalesce(F.col(f"{c}{k}").cast("string"), F.lit("0")) for c in halves for k in "xs"))
    return folded.select(*(group or []), "n", F.sha2(text, 256).alias("digest"), *kept)


def compose(sources: dict[str, DataFrame], leaf: list[str], columns: list[str], settings: dict[str, str]) -> DataFrame:
    """(n, leaves, n_sources, content_digest, input_key): one row on the snapshot of several tables with the same columns.

    The content's digest is of all leaves' digests by source; the input key also tells
    the settings that it was made with. Both are the same for any order of rows, sources
    and settings.
    """
    leaves = reduce(DataFrame.unionByName, (table_digest(df, columns, leaf).withColumn("source", F.lit(name)) for name, df in sources.items()))
    told = ";".join(f"{k}={settings[k]}" for k in sorted(settings)) + "|" + ",".join(sorted(sources))
    whole = table_digest(leaves, ["source", *leaf, "n", "digest"], None, F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_distinct("source").alias("n_sources"))
    return whole.select(F.col("rows").alias("n"), F.col("n").alias("leaves"), "n_sources", F.col("digest").alias("content_digest"), F.sha2(F.concat(F.col("digest"), F.lit("|" + told)), 256).alias("input_key"))


def same_but(left: DataFrame, right: DataFrame, key: list[str], volatile: list[str]) -> DataFrame:
    """(key, same): for each key of both tables whether all other columns but the volatile ones are equal, nulls too."""
    held = [c for c in left.columns if c not in key and c not in volatile]
    a, b = (df.select(*key, F.struct(*held).alias(name)) for df, name in ((left, "__l"), (right, "__r")))
    return a.join(b, key).select(*key, F.col("__l").eqNullSafe(F.col("__r")).alias("same"))


def required_contexts(df: DataFrame, bucket: str, context: str, required: dict[str, list[str]], exact: list[str], equal: tuple[str, str]) -> DataFrame:
    """(bucket, n, missing, extra, passed) for each required bucket, those without rows too.

    missing are its required contexts without rows. In exact buckets no other context may
    occur (extra); in the others the two contexts of ``equal`` must have as many rows.
    """
    names = sorted({c for contexts in required.values() for c in contexts} | set(equal))
    counts = df.where(F.col(bucket).isin(*required)).groupBy(bucket).pivot(context, names).agg(F.count(F.lit(1)))
    own = df.where(F.col(bucket).isin(*required)).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(context)).alias("__seen"))
    wanted = df.sparkSession.createDataFrame([(b, sorted(c), b in exact) for b, c in required.items()], f"{bucket} string, __wanted array<string>, __exact boolean")
    seen = F.coalesce("__seen", F.array().cast("array<string>"))
    n = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(0))
    missing, extra = F.array_except("__wanted", seen), F.when(F.col("__exact"), F.array_except(seen, "__wanted")).otherwise(F.array().cast("array<string>"))
    alike = F.col("__exact") | (n(equal[0]) == n(equal[1]))
    joined = wanted.join(own, bucket, "left").join(counts, bucket, "left")
    return joined.select(bucket, F.coalesce("n", F.lit(0)).alias("n"), F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("extra"), ((F.size(missing) == 0) & (F.size(extra) == 0) & alike).alias("passed"))
