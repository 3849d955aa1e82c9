"""Catalogs: counters merge in any order, odd rows, strategies that aren't there."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import catalogs


def test_counters_of_parts_are_those_of_the_whole(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"k{i % 3}", None if i % 5 == 0 else i) for i in range(100)], "i int, k string, n int")
    one = lambda d: catalogs.counters(d, {"n": F.col("n")}, {"k": F.col("k")})
    whole = sorted(map(tuple, one(df).collect()))
    assert sorted(map(tuple, catalogs.merged(*(one(df.where(F.col("i") % 4 == r)) for r in (2, 0, 3, 1))).collect())) == whole
    assert sum(n for c, _, n in whole if c == "k") == 85 and ("n", "", sum(i for i in range(100) if i % 5)) in whole
    assert one(df.where("i > 200")).count() == 0


def test_pairs(spark):
    rows = [(1, "no_memory", "a"), (1, "with_memory", "a"), (2, "no_memory", "a"), (2, "with_memory", "b"), (3, "no_memory", "a"), (4, "no_memory", "a"), (4, "no_memory", "a"), (5, "no_memory", None), (5, "with_memory", None), (6, "other", "a"), (6, "with_memory", "a")]
    got = {r[0]: tuple(r)[1:] for r in catalogs.broken_pairs(spark.createDataFrame(rows, "b int, v string, f string"), "b", "v", "f").collect()}
    assert got == {2: (2, False, 1, 1, False), 3: (1, True, 1, 0, False), 4: (2, True, 2, 0, True), 5: (2, False, 1, 1, False), 6: (2, True, 0, 1, False)}


def test_manifests_are_ready_if_every_row_is(spark):
    df = spark.createDataFrame([(1, "a", True, 2), (2, "a", True, 1), (3, "b", None, 1)], "k int, g string, r boolean, v int")
    got = {r["group"]: (r["episodes"], r["ready"], r["views"], r["release_ready"]) for r in catalogs.manifest_report(df, "k", "g", F.col("r"), F.col("v")).collect()}
    assert got == {"a": (2, 2, 3, True), "b": (1, 0, 1, False), None: (3, 2, 4, False)}
    assert catalogs.manifest_report(df.where("k > 5"), "k", "g", F.col("r"), F.col("v")).collect() == []


def test_strategies(spark):
    with pytest.raises(ValueError, match="strategy"):
        catalogs.inventory_shard("other", F.lit("a"), F.lit("b"), F.lit("c"), 4)
    df = spark.createDataFrame([(f"e{i}", "s", f"t{i % 3}") for i in range(30)], "e string, s string, t string")
    by = df.select("t", catalogs.inventory_shard("topic", *map(F.col, "est"), 8).alias("k")).groupBy("t").agg(F.count_distinct("k").alias("n")).collect()
    assert {r["n"] for r in by} == {1}
