"""Text helpers: folding in one pass gives what folding by one letter after the other does, and no step works a text out more than once."""

from pyspark.sql import functions as F

from loomspan.functions import text


def _plan(spark, column):
    return spark.range(1).select(F.col("id").cast("string").alias("c")).repartition(1).select(column).toDF("x")._jdf.queryExecution().optimizedPlan().toString()


def test_folding_is_casefold(spark):
    rows = [(k, "".join(c for c, _ in text._FOLDS[k::7]) + "aß ς.x" + chr(0x1E9E)) for k in range(7)] + [(7, ""), (8, None), (9, "ß"), (10, "no letter to fold"), (11, "ŉé𝒳ﬃ")]
    got = dict(spark.createDataFrame(rows, "k int, c string").select("k", text.folded(F.col("c"))).collect())
    assert got == {k: None if c is None else c.casefold() for k, c in rows}


def test_white_space_is_collapsed_once(spark):
    for make in (text.collapsed, text.normalised, text.is_latin_caption):
        assert _plan(spark, make(F.col("c"))).count("\\p{Z}") == 1
    assert _plan(spark, text.folded(F.col("c"))).count("lower(") == 1


def test_null_words_and_ends(spark):
    rows = [("UNKNOWN", ""), (" Nan ", ""), ("ununknown", "ununknown"), ("a.. , …", "a"), ("a . b .", "a . b"), ("...", "")]
    got = [tuple(r) for r in spark.createDataFrame([(c,) for c, _ in rows], "c string").select("c", text.normalised(F.col("c"))).collect()]
    assert got == rows
