"""Contracts: a document is parsed once however many rules look at it; scores read only what they need."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import contracts, scores
from loomspan.plans import targets


@pytest.mark.parametrize(("make", "most"), [
    (lambda t, c: contracts.level_target(t, c), 1), (lambda t, c: contracts.level_plan(t, c), 1), (lambda t, c: contracts.window_target(t, c, F.lit(True)), 2), (lambda t, c: contracts.target(t, c, F.lit(targets._SINGLE)), 3), (lambda t, c: contracts.prompt_context(t, c, c, F.lit(targets._SINGLE)), 3),
])
def test_a_document_is_parsed_once(spark, make, most):
    df = spark.createDataFrame([("{}", "x")], "t string, c string")
    plan = df.select(make(F.col("t"), F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("parseJson(") <= most


def test_a_score_alone(spark):
    window = targets._WINDOW.replace("NAME", "it")
    rows = [(1, window, window, "L3L1L0"), (2, "{", window, "L3L1L0"), (3, window, "{", "L3L1L0"), (4, "[" * 5000, window, "L3L1L0"), (5, None, None, None)]
    df = scores.target_scores(spark.createDataFrame(rows, "id int, t string, g string, p string"), "t", "g", "p")
    assert dict(df.select("id", "scored.score").collect()) == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}
    assert dict(df.select("id", "scored.error").collect()) == {1: None, 2: "target_names", 3: "target", 4: "target_names", 5: "profile"}
