"""Contracts: every rule of the queries fails somewhere; odd documents; targets that a prompt's instruction completes."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import contracts
from loomspan.plans import targets


@pytest.mark.parametrize(("name", "cases", "rules"), [
    ("target_contract", targets._TARGETS, 45), ("prompt_contract", targets._CONTEXTS, 17), ("window_contract", targets._WINDOWS, 17), ("plan_contract", targets._TREES, 10), ("spec_contract", targets._SPECS, 9),
])
def test_the_cases_break_many_rules_and_some_break_none(name, cases, rules):
    names = [c[-1] for c in cases]
    assert None in names and len({*names} - {None}) >= rules - 8


def test_documents_that_are_none(spark):
    rows = [(1, None), (2, ""), (3, "{"), (4, "null"), (5, "7"), (6, '"x"'), (7, "[]"), (8, "{}"), (9, '{"task":null,"predictions":null}')]
    df = spark.createDataFrame(rows, "id int, t string")
    t, spec = F.col("t"), F.lit(targets._SINGLE)
    got = df.select("id", contracts.target(t, F.lit("ongoing"), spec).alias("a"), contracts.window_target(t, F.lit("L3L1"), F.lit(False)).alias("b"), contracts.level_plan(t, F.lit("full")).alias("c"), contracts.prompt_context(t, F.lit("with_memory_no_initial"), F.lit("ongoing"), spec).alias("d"), contracts.output_spec(t, F.lit("end")).alias("e")).collect()
    assert all(x is not None for r in got for x in r)
    assert {r["id"]: r["a"] for r in got}[8] == "target_names" and {r["id"]: r["b"] for r in got}[9] == "task_names"


def test_targets_of_an_instruction(spark):
    window = '{"task_progress_percent":9,"predictions":' + targets._WINDOW[targets._WINDOW.index('"predictions":') + 14 :]
    tree = '{"initial_plan":' + targets._TREE[targets._TREE.index('"initial_plan":') + 15 :]
    rows = [
        (1, window, "L3L1L0", "continuous", 'sort "it"', False), (2, window, "L3L1L0", "continuous", "7", False), (3, window, "L3L1L0", "terminal", "sort", True), (4, window.replace(":9,", ":900,"), "L3L1L0", "continuous", "sort", False),
        (5, tree, "full", "initial_plan", "sort", False), (6, tree, "full", "initial_plan", "sort", True), (7, tree, "full", "other", "sort", False), (8, tree, "full", "continuous", "sort", False), (9, tree, "L3L2", "initial_plan", None, False),
    ]
    df = spark.createDataFrame(rows, "id int, t string, p string, k string, i string, e boolean")
    got = {r[0]: r[1] for r in df.select("id", contracts.instructed_target(*map(F.col, "tpkie"))).collect()}
    assert got == {1: None, 2: "instruction", 3: "window_end", 4: "task_progress", 5: None, 6: "plan_of_end", 7: "kind", 8: "target_names", 9: "instruction"}


def test_counts_that_are_expected(spark):
    df = spark.createDataFrame([(targets._WINDOW, targets._TREE)], "w string, t string")
    w, t = F.col("w"), F.col("t")
    row = df.select(contracts.level_target(w, F.lit("L3L1L0"), F.lit(1)), contracts.level_target(w, F.lit("L3L1L0")), contracts.level_plan(t, F.lit("full"), F.lit(1)), contracts.level_plan(t, F.lit("full"), F.lit(2))).first()
    assert tuple(row) == ("predictions_expected", None, None, "plan_expected")
