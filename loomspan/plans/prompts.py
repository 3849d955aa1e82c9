"""Queries on prompt memory: events as outputs of a model that plans by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.times import micros
from loomspan.sources.tables import table
from loomspan.streaming import prompt

_ACTION = "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END"
_SEGMENT = "CASE WHEN event_id % 3 = 0 THEN 'step ' || (event_id % 5) WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'é ' || event_type END"
_PERCENT = "CAST(least(greatest(floor(value), 0), 99) AS INT)"
_VALID, _PREDICTED = "event_type <> 'error'", "event_id % 11 <> 0"
#: twelve hours without an event
_IDLE = 12 * 3600 * 1_000_000


def outputs(events: DataFrame) -> DataFrame:
    """Events as model outputs: errors can't be read, some have no prediction, some no unit."""
    return events.select(
        F.col("user_id").cast("string").alias("key"), micros("ts").alias("at"), F.col("event_id").alias("seq"), F.expr(_VALID).alias("valid"), F.expr(_PREDICTED).alias("predicted"),
        F.expr(_ACTION).alias("action"), F.expr(_PERCENT).alias("action_progress"), F.expr(_SEGMENT).alias("segment"), F.expr(f"99 - {_PERCENT}").alias("segment_progress"), (F.col("event_id") % 100).cast("int").alias("task_progress"),
    )


def plan_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's prompt: the distinct plan steps of its user and the last prediction before it, and what the event changes."""
    return prompt.batch_prompts(outputs(table(spark, sf_dir, "events")), "plan", _IDLE)


def bank_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's prompt with the debounced states of its user."""
    return prompt.batch_prompts(outputs(table(spark, sf_dir, "events")), "bank", _IDLE)


def held_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the last output of its user that could be read."""
    own = outputs(table(spark, sf_dir, "events"))
    return prompt.hold_last_valid(own, ["key"], ["at", "seq"], "action", "valid").select("key", "seq", "held")


def first_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the first of its first three lines, by number, that was not returned."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("part")).withColumn("attempt", F.col("l_linenumber") - 1)
    return prompt.first_valid_attempt(lines.withColumn("good", F.col("flag") == "N"), ["l_orderkey"], "attempt", "part", "good", 3)


def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of work and waiting between neighbouring events of a user, read as counters."""
    own = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_id DIV 3 * 40 AS total", "event_id DIV 5 * 20 AS idle", "event_id DIV 7 * 3 AS waiting")
    return prompt.counter_rates(own, ["user_id"], ["event_id"], "total", "idle", "waiting").select("user_id", "event_id", "busy", "waited")


QUERIES = {f.__name__: f for f in (plan_prompts, bank_prompts, held_outputs, first_attempts, counter_rates)}

_OUT = f"""o AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS "at", event_id AS seq, {_VALID} AS valid, {_PREDICTED} AS predicted, {_ACTION} AS action, {_PERCENT} AS ap, {_SEGMENT} AS segment, 99 - {_PERCENT} AS sp, (event_id % 100)::INT AS task,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {_IDLE}, true) AS fresh FROM events)"""
_UNIT = lambda u, c, p: f"""'"{u}":{{"caption":"' || {c} || '","progress_percent":' || {p} || '}}'"""
ORACLES = {
    "plan_prompts": f"""
        WITH RECURSIVE {_OUT},
        s(key, n, "at", seq, long, short, before, bshort, what) AS (
            SELECT key, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::STRUCT(a VARCHAR, s VARCHAR)[], 'null', []::STRUCT(a VARCHAR, s VARCHAR)[], 'null', '' FROM (SELECT DISTINCT key FROM o)
            UNION ALL
            SELECT key, n, "at", seq, CASE WHEN what = 'prediction1_committed' THEN list_append(l, {{'a': action, 's': segment}})[-8:] ELSE l END, CASE WHEN what IN ('prediction1_committed', 'prediction1_duplicate_short_only') THEN now ELSE sh END, l, sh, what FROM (
                SELECT *, CASE WHEN NOT valid THEN 'invalid_json_state_unchanged' WHEN NOT predicted THEN 'decision_without_predictions_state_unchanged' WHEN action IS NULL AND segment IS NULL THEN 'prediction1_has_no_units_state_unchanged'
                    WHEN list_contains(list_transform(l, lambda x: lower(coalesce(x.a, '')) || '|' || lower(coalesce(x.s, ''))), lower(coalesce(action, '')) || '|' || lower(coalesce(segment, ''))) THEN 'prediction1_duplicate_short_only' ELSE 'prediction1_committed' END AS what,
                    '{{"prediction1":{{' || concat_ws(',', {_UNIT("action", "action", "ap")}, {_UNIT("segment", "segment", "sp")}) || '}},"task_progress_percent":' || task || '}}' AS now
                FROM (SELECT o.*, CASE WHEN o.fresh THEN [] ELSE s.long END AS l, CASE WHEN o.fresh THEN 'null' ELSE s.short END AS sh FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1))),
        t AS (SELECT *, '[' || array_to_string(list_transform(before, lambda x, i: '{{' || concat_ws(',', '"action":"' || x.a || '"', '"index":' || i, '"segment":"' || x.s || '"') || '}}'), ',') || ']' AS bl,
            '[' || array_to_string(list_transform(long, lambda x, i: '{{' || concat_ws(',', '"action":"' || x.a || '"', '"index":' || i, '"segment":"' || x.s || '"') || '}}'), ',') || ']' AS al FROM s WHERE n > 0)
        SELECT key, "at", seq, bl AS long_memory, bshort AS short_memory, what, len(long)::INT AS n_long, sha256('{{"long_memory":' || bl || ',"short_memory":' || bshort || '}}') AS before_sha256, sha256('{{"long_memory":' || al || ',"short_memory":' || short || '}}') AS after_sha256 FROM t""",
    "held_outputs": f"WITH {_OUT} SELECT key, seq, last_value(CASE WHEN valid THEN action END IGNORE NULLS) OVER (PARTITION BY key ORDER BY n ROWS UNBOUNDED PRECEDING) AS held FROM o",
    "first_attempts": """
        WITH l AS (SELECT l_orderkey, l_linenumber - 1 AS attempt, min(l_returnflag) AS flag, min(l_partkey) AS part FROM lineitem GROUP BY ALL HAVING l_linenumber <= 3)
        SELECT l_orderkey, count(*) AS attempts, min(attempt) FILTER (flag = 'N') > 0 AS retried, arg_min(part, attempt) FILTER (flag = 'N') AS part FROM l GROUP BY 1""",
    "counter_rates": """
        WITH c AS (SELECT user_id, event_id, event_id // 3 * 40 AS t, event_id // 5 * 20 AS i, event_id // 7 * 3 AS w FROM events),
        d AS (SELECT user_id, event_id, t - lag(t) OVER b AS t, i - lag(i) OVER b + w - lag(w) OVER b AS i, w - lag(w) OVER b AS w FROM c WINDOW b AS (PARTITION BY user_id ORDER BY event_id))
        SELECT user_id, event_id, CASE WHEN t > 0 THEN round(100.0 * greatest(0, t - i) / t, 3) END AS busy, CASE WHEN t > 0 THEN round(100.0 * greatest(0, w) / t, 3) END AS waited FROM d""",
}
