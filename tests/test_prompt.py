"""Prompt memory: emitted before it is updated, in batch against plain Python, and as a stream with mixed and late rows and a restart."""

import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomspan.plans.prompts import _IDLE, outputs
from loomspan.sources.tables import table
from loomspan.streaming import prompt


def row(at, seq=0, valid=True, predicted=True, action="Pick", segment=None, key="k"):
    return {"key": key, "at": at, "seq": seq, "valid": valid, "predicted": predicted, "action": action, "action_progress": 5, "segment": segment, "segment_progress": 6, "task_progress": 7}


def test_a_prompt_shows_what_was_before_it():
    held = prompt._Held("plan", 100)
    steps = [held.take("k", r) for r in (row(0), row(1, action="pick"), row(2, valid=False), row(3, predicted=False), row(4, action=None), row(5, segment="go"), row(200))]
    assert [s[5] for s in steps] == ["prediction1_committed", "prediction1_duplicate_short_only", "invalid_json_state_unchanged", "decision_without_predictions_state_unchanged", "prediction1_has_no_units_state_unchanged", "prediction1_committed", "prediction1_committed"]
    assert [s[3] for s in steps[:2]] == ["[]", '[{"action":"Pick","index":1}]'] and steps[-1][3] == "[]"
    assert all((s[7] == s[8]) == ("unchanged" in s[5]) for s in steps if "duplicate" not in s[5])
    assert json.loads(steps[2][4])["prediction1"]["action"]["caption"] == "pick"


def test_only_the_last_eight_pairs_are_kept():
    held = prompt._Held("plan", 1000)
    for k in range(12):
        held.take("k", row(k, action=f"a{k}"))
    assert [p[0] for p in held.memory.pairs] == [f"a{k}" for k in range(4, 12)]
    assert held.take("k", row(20, action="A0"))[5] == "prediction1_committed"  # it was forgotten


def test_the_bank_holds_the_last_valid_state():
    held = prompt._Held("bank", 1000)
    said = [row(0, action="pick up", segment="place"), row(1, action="pick up"), row(2, valid=False), row(3, action="place"), row(4, action="place")]
    got = [held.take("k", r) for r in said]
    assert [g[5] for g in got] == ["initialized", "active_stable", "invalid_output_hold_last_valid", "transition_candidate", "transition_committed"]
    assert got[3][4] == got[2][4] and held.memory.bank.shown == ["pick up"] and got[4][3] == "[]"


def test_batch_equals_plain_python(spark, small):
    rows = [r.asDict() for r in outputs(table(spark, small, "events")).collect()]
    for kind in prompt.KINDS:
        held, want = {}, []
        for r in sorted(rows, key=lambda r: (r["key"], r["at"], r["seq"])):
            want.append(held.setdefault(r["key"], prompt._Held(kind, _IDLE)).take(r["key"], r))
        assert sorted(tuple(r) for r in prompt.batch_prompts(outputs(table(spark, small, "events")), kind, _IDLE).collect()) == sorted(want)


def test_odd_rows(spark):
    schema = "key string, at long, seq long, valid boolean, predicted boolean, action string, action_progress int, segment string, segment_progress int, task_progress int, what string"
    rows = [("a", None, 1, True, True, "x", 1, None, None, 1, "q"), (None, 5, 1, True, True, "x", 1, None, None, 1, "q"), ("a", 5, None, None, None, None, None, None, None, None, None), ("a", 6, 1, True, True, "x", None, None, None, None, "q")]
    got = prompt.batch_prompts(spark.createDataFrame(rows, schema)).collect()
    assert [(r["at"], r["what"]) for r in sorted(got, key=lambda r: r["at"])] == [(5, "invalid_json_state_unchanged"), (6, "prediction1_committed")]
    assert prompt.batch_prompts(spark.createDataFrame([], schema)).count() == 0


def test_stream_equals_batch_with_mixed_rows_and_a_restart(spark, small, tmp_path):
    """Rows come up to some hours out of order, in four files; the query is stopped and begun again between them; one row is late, one far ahead ends the time."""
    every = outputs(table(spark, small, "events")).withColumn("ts", (F.col("at") / 1e6).cast("timestamp"))
    rows = sorted((tuple(r) for r in every.collect()), key=lambda r: (r[1] // 7_200_000_000, r[2] % 7))
    end = max(r[1] for r in rows)
    late = ("0", min(r[1] for r in rows), -1, True, True, "late", 1, None, None, 1, rows[0][-1])
    ahead = [(k, end + 10 * _IDLE, 10**9, True, True, "end", 1, None, None, 1, rows[0][-1].fromtimestamp((end + 10 * _IDLE) / 1e6)) for k in sorted({r[0] for r in rows})]
    kinds = StructType([StructField(f.name, f.dataType) for f in every.schema])
    parts = [rows[:300], rows[300:600], rows[600:] + [late], ahead[:1]]
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, part in enumerate(parts):
            spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
            query = prompt.stream_prompts(source, "plan", _IDLE, "3 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(300)
            assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["seq"] < 10**9)
    want = sorted(tuple(r) for r in prompt.batch_prompts(every, "plan", _IDLE).collect())
    assert got == want
