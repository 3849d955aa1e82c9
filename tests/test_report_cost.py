"""Reports of scores: every document is scored once, on all of the session's tasks; the report is that of plain Python."""

import random
from collections import Counter

import pytest

from loomspan.operators import scores
from loomspan.plans import scores as plans
from loomspan.plans import targets

KIND = "scored struct<score:double,exact:boolean,valid:boolean,matched:int,total:int,error:string>"


def test_a_document_is_scored_once(spark, small):
    plan = plans.score_report(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and plan.count("ArrowEvalPython") == 1 and plan.count("Relation [") == 1


@pytest.mark.parametrize("name", ["target_scores", "score_report"])
def test_one_small_file_is_scored_by_all_tasks(spark, small, name):
    plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {max(4, spark.sparkContext.defaultParallelism)}, true" in plan
    assert plan.index("ArrowEvalPython") < plan.index("Repartition ")


@pytest.mark.parametrize("name", sorted(targets.QUERIES))
def test_one_small_file_is_judged_by_all_tasks(spark, small, name):
    plan = targets.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {max(4, spark.sparkContext.defaultParallelism)}, true" in plan
    assert plan.index("parseJson(") < plan.index("Repartition ")


@pytest.mark.parametrize(("n", "kinds", "top"), [(0, 3, 10), (1, 1, 10), (300, 5, 10), (300, 40, 10), (300, 40, 1), (200, 0, 10)])
def test_report_against_plain_python(spark, n, kinds, top):
    r = random.Random(n + kinds)
    some = lambda x: None if r.random() < 0.1 else x
    rows = [((some(r.randint(0, 8) / 8), some(r.random() < 0.5), some(r.random() < 0.5), 1, 1, some(f"e{r.randrange(kinds)}") if kinds else None),) for _ in range(n)]
    got = scores.score_report(spark.createDataFrame(rows, KIND), "scored", top).first()
    own = [x for (x,) in rows]
    for k, name in enumerate(("score", "exact_rate", "valid_rate")):
        told = [x[k] for x in own if x[k] is not None]
        assert got[name] == pytest.approx(sum(told) / len(told) if told else 0.0, abs=1e-9)
    most = sorted(Counter(x[5] for x in own if x[5] is not None).items(), key=lambda x: (-x[1], x[0]))[:top]
    assert got["samples"] == n and got["top_errors"] == ",".join(f"{e}:{c}" for e, c in most)
