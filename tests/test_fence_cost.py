"""The passage fence splits a body once, not once for each of its places."""

from pyspark.sql import functions as F

from loomspan.operators import merging


def test_a_body_is_split_once(spark):
    text = " ".join(f"w{k}" for k in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "w5 w6"), (3, None), (4, "")], "d int, t string")
    held = spark.createDataFrame([(1, "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19"), (2, "w5 w6"), (3, "w5 w7"), (4, "w10 w11 w12 w13 w14 w15 w16 w17 w18 x")], "i int, p string")
    found = merging.holdings(docs, "d", F.col("t"), held, "i", F.col("p"))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (1, 2), (2, 2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(__b") + plan.count("split(t#") == 1
