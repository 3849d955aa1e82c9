"""Every query of the library against its SQL, on whole tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from loomspan import catalog


def cell(x):
    if x is None:
        return (0, "")
    if isinstance(x, bool):
        return (1, str(x))
    if isinstance(x, (int, float, decimal.Decimal)):
        return (2, f"{float(x):.6g}" if not math.isnan(float(x)) else "nan")
    if isinstance(x, (datetime.date, datetime.datetime)):
        return (3, x.isoformat())
    return (4, str(x))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    sql = duck.sql(catalog.ORACLES[name])
    assert sorted(sql.columns) == columns
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    want = sorted(tuple(cell(x) for x in r) for r in sql.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())
    assert got == want
    assert got


@pytest.mark.parametrize(("name", "column", "values"), [
    ("holdout_fence", "match", {"whole", "first", "last", None}), ("strict_union", "conflict", {True, False}), ("group_gapless", "complete", {True, False}), ("profile_choice", "profile", {"full", "L3L2L1", "L3L2L0", "L3L2", "L3L1L0", "L3L1", None}),
    ("level_verdicts", "reason", {"duplicate_unit_id", "invalid_caption", "interval_too_short", "same_level_overlap", "invalid_l0_source"}), ("json_repairs", "done", {None}), ("target_contract", "rule", {None, "task_progress", "failure_type"}),
    ("noisy_contexts", "kind", {"progress_0_100", "causal_window_shift", "cross_train_episode_short_memory"}), ("noisy_contexts", "changed", {True}), ("box_frames", "reason", {None, "invalid_box", "no_count"}), ("strict_intervals", "error", {None, "invalid_entry", "invalid_interval", "beyond_total", "missing"}),
    ("plan_prompts", "what", {"prediction1_committed", "prediction1_duplicate_short_only", "prediction1_has_no_units_state_unchanged", "invalid_json_state_unchanged"}), ("swept_media", "kind", {"collection", "flat"}), ("caption_alignment", "extra", {0.0}),
])
def test_every_branch_occurs(duck, name, column, values):
    found = {r[0] for r in duck.sql(catalog.ORACLES[name]).select(duckdb.ColumnExpression(column)).distinct().fetchall()}
    assert values <= found


def test_lines_that_are_cut_off_are_told(duck):
    assert duck.sql(f"SELECT sum(n_broken) FROM ({catalog.ORACLES['json_buckets']})").fetchall()[0][0] == 20


def test_passage_fence_finds_items_inside_texts(spark):
    """The SQL on more rows, some of which hold an item in their middle."""
    found = catalog.QUERIES["passage_fence"](spark, "/root/testdata/sf0.01").where("n_items > 0").count()
    con = duckdb.connect()
    verbatim = con.execute("SELECT count(*) FROM '/root/testdata/sf0.01/documents.parquet' d WHERE EXISTS (FROM '/root/testdata/sf0.01/benchmark.parquet' b WHERE contains(d.text, b.text))").fetchone()[0]
    assert found >= verbatim > 0


def test_bootstrap_interval_holds_the_mean(spark, small):
    for r in catalog.QUERIES["score_interval"](spark, small).collect():
        assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 20


@pytest.mark.parametrize(("raw", "clean", "normal", "valid"), [("\u00a0Unknown\u2003", "", "", False), ("NA", "", "", False), ("a\u3000 STRASSE ß\u00a0。 ", "a STRASSE ß 。", "a strasse ss", True), ("语 ok", "语 ok", "语 ok", False), (None, "", "", False)])
def test_captions_as_written(spark, raw, clean, normal, valid):
    from pyspark.sql import functions as F

    from loomspan.functions import text

    c = F.col("c")
    assert tuple(spark.createDataFrame([(raw,)], "c string").select(text.collapsed(c), text.normalised(c), text.is_latin_caption(c)).first()) == (clean, normal, valid)
