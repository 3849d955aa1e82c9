"""Queries on scores of targets, reports, runs, picks and paired shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import scores
from loomspan.plans.targets import _WINDOW, _case
from loomspan.sources.tables import dealt, table

_SQL = lambda text: "'" + text.replace("'", "''").replace("NAME", "' || p_name || '") + "'"
_SAID = (
    (_WINDOW, 13, None), (_WINDOW.replace("place it", "drop it"), 12, None), (_WINDOW.replace('"source":"segment"', '"source":"human_segment"'), 12, None), (_WINDOW.replace(":9}", ":10}").replace(":5}", ":6}"), 11, None),
    (_WINDOW[: _WINDOW.index(',{"index":2')] + "]}", 7, None), (_WINDOW.replace('"task"', '"job"'), 0, "target_names"), ("  " + _WINDOW.replace("place it", "PLACE  it!") + " ", 13, None), ("{", 0, "target_names"), (_WINDOW.replace(":5}", ":500}"), 0, "progress"),
)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name"))
    own = part.select("p_partkey", F.expr(_case([_SQL(s[0]) for s in _SAID])).alias("said"), F.expr(_SQL(_WINDOW)).alias("meant"), F.lit("L3L1L0").alias("profile"))
    return scores.target_scores(own, "said", "meant", "profile")


def target_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a target each text has right, leaf by leaf."""
    return _scored(spark, sf_dir).select("p_partkey", F.round("scored.score", 9).alias("score"), *(f"scored.{c}" for c in ("exact", "valid", "matched", "total", "error")))


def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and shares of those scores, and the rules that are broken most."""
    return scores.score_report(_scored(spark, sf_dir), "scored")


def _columns(select: str) -> list[str]:
    """The expressions of a SELECT from one table; none of them has a comma of its own."""
    return select.removeprefix("SELECT ").rsplit(" FROM ", 1)[0].split(", ")


_SLOTS = "SELECT event_id, event_type, user_id % 3 AS variant, event_id % 400 AS slot, event_id % 5 <> 0 AS valid, CASE WHEN event_id % 7 <> 0 THEN value / 100 END AS caption, CAST(floor(value) AS INT) - 20 AS off FROM events"


def rollout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by variant and kind, against 450 slots that each should have."""
    own = table(spark, sf_dir, "events").selectExpr(*_columns(_SLOTS))
    wanted = own.select("variant", "event_type").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(449))))
    return scores.rollout_summary(own, ["variant", "event_type"], "slot", "valid", "caption", "off", wanted)


def paired_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by how they are shipped against those of the same order and number that aren't returned."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.min("l_quantity").alias("q"))
    return scores.paired_rollouts(own, ["l_orderkey", "l_linenumber"], "l_returnflag", "N", "q")


def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of events as scanned episodes, errors as failures."""
    own = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id") % 4).alias("source"), F.when(F.col("event_type") == "error", "failed").otherwise("accepted").alias("status"), (F.col("event_id") % 5).alias("samples"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("e"), F.col("event_id") % 4)).alias("error"), (F.col("event_id") % 2 == 0).alias("retryable"))
    return scores.scan_statistics(own, "source", "status", "samples", "error", "retryable")


def review_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders of each customer for review."""
    own = table(spark, sf_dir, "orders")
    return scores.review_picks(own, "o_custkey", "o_orderkey", [F.when(F.col("o_totalprice") > 200_000, 0).otherwise(1), -F.col("o_totalprice")], [F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.col("o_orderdate")])


def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """97 orders, evenly spaced by price."""
    return scores.evenly_spaced(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 97)


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty lines' orders by a seeded hash."""
    return scores.seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 50, 7)


def prompt_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations that hold words they mustn't, by role."""
    return scores.prompt_leaks(table(spark, sf_dir, "conversations"), "text", ["role"], ["the ", "éau", "|"])


_LEAVES = "SELECT n_nationkey AS name, CASE WHEN n_nationkey < 20 THEN n_nationkey % 10 END AS pair, n_nationkey < 10 AS side, 40 + CASE WHEN n_nationkey < 20 THEN n_nationkey % 10 ELSE n_nationkey END * 7 % 5 AS size FROM nation"


def paired_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as leaves: ten pairs and five alone, 1,999 exposures."""
    return scores.paired_allocation(table(spark, sf_dir, "nation").selectExpr(*_columns(_LEAVES)), "name", "pair", "side", "size", 1999, True)


QUERIES = {f.__name__: f for f in (target_scores, score_report, rollout_summary, paired_rollouts, scan_statistics, review_picks, evenly_spaced, seeded_sample, prompt_leaks, paired_allocation)}

_SCORED = f"""SELECT p_partkey, round(CASE WHEN e IS NULL THEN m / 13 ELSE 0 END, 9) AS score, e IS NULL AND m = 13 AS exact, e IS NULL AS valid, m AS matched, CASE WHEN e IS NULL THEN 13 ELSE 1 END AS total, e AS error
    FROM (SELECT p_partkey, {_case([str(s[1]) for s in _SAID])} AS m, {_case([f"'{s[2]}'" if s[2] else "NULL" for s in _SAID])} AS e FROM part)"""
ORACLES = {
    "target_scores": _SCORED,
    "score_report": f"""
        WITH s AS ({_SCORED.replace("round(CASE WHEN e IS NULL THEN m / 13 ELSE 0 END, 9)", "CASE WHEN e IS NULL THEN m / 13 ELSE 0 END")}), e AS (SELECT error, count(*) AS n FROM s WHERE error IS NOT NULL GROUP BY 1)
        SELECT count(*) AS samples, round(avg(score), 9) AS score, round(avg(exact::INT), 9) AS exact_rate, round(avg(valid::INT), 9) AS valid_rate, (SELECT string_agg(error || ':' || n, ',' ORDER BY n DESC, error) FROM e) AS top_errors FROM s""",
    "rollout_summary": f"""
        WITH e AS ({_SLOTS}) SELECT variant, event_type, 450 AS slots, count(DISTINCT slot) AS generated, round(count(DISTINCT slot) / 450, 9) AS coverage, round(avg(valid::INT), 9) AS valid_rate,
            round(avg(CASE WHEN valid THEN coalesce(caption, 0) ELSE 0 END), 9) AS mean_caption, round(avg(CASE WHEN valid THEN abs(off) ELSE 100 END), 9) AS mae FROM e GROUP BY 1, 2""",
    "paired_rollouts": """
        WITH q AS (SELECT l_orderkey, l_linenumber, l_returnflag, min(l_quantity) AS q FROM lineitem GROUP BY ALL), d AS (SELECT a.l_returnflag, a.q - b.q AS d FROM q a JOIN q b USING (l_orderkey, l_linenumber) WHERE a.l_returnflag <> 'N' AND b.l_returnflag = 'N')
        SELECT l_returnflag, count(*) AS pairs, round(avg(d), 9) AS mean_delta, count(*) FILTER (d > 0) AS better, count(*) FILTER (d < 0) AS worse FROM d GROUP BY 1""",
    "scan_statistics": """
        WITH e AS (SELECT 's' || user_id % 4 AS source, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'accepted' END AS status, event_id % 5 AS samples, CASE WHEN event_id % 3 <> 0 THEN 'e' || event_id % 4 ELSE 'unknown_error' END AS error, event_id % 2 = 0 AS again FROM events)
        SELECT 'status' AS section, source, status AS name, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'samples', source, 'samples', sum(samples)::BIGINT FROM e GROUP BY ALL
        UNION ALL SELECT 'error', '', error, count(*) FROM e WHERE status = 'failed' GROUP BY ALL UNION ALL SELECT 'retryable', '', 'retryable', count(*) FROM e WHERE status = 'failed' AND again HAVING count(*) > 0""",
    "review_picks": """
        WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice <= 200000, -o_totalprice, o_orderkey) AS a FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY a = 1, o_orderstatus <> 'F', o_orderdate, o_orderkey) AS b FROM a)
        SELECT o_custkey, o_orderkey, 'transition' AS role FROM b WHERE a = 1 UNION ALL SELECT o_custkey, o_orderkey, 'terminal' FROM b WHERE b = 1""",
    "evenly_spaced": """
        WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, o_totalprice FROM r WHERE r IN (SELECT i * (n - 1) // 96 FROM range(97) t(i), (SELECT any_value(n) AS n FROM r))""",
    "seeded_sample": "SELECT o_orderkey, o_custkey FROM orders ORDER BY sha256('7' || chr(0) || o_orderkey), o_orderkey LIMIT 50",
    "prompt_leaks": "SELECT role, count(*) AS prompts, count(*) FILTER (contains(text, 'the ') OR contains(text, 'éau') OR contains(text, '|')) AS leaks FROM conversations GROUP BY 1",
    "paired_allocation": f"""
        WITH l AS ({_LEAVES}), t AS (SELECT 1999 - sum(size)::BIGINT AS rest FROM l), u AS (SELECT coalesce('p' || pair, 's' || name) AS unit, max(size) AS w, max(name::VARCHAR) AS n FROM l GROUP BY 1),
        x AS (SELECT *, (rest // 2 * w) // sum(w) OVER () AS f, (rest // 2 * w) % sum(w) OVER () AS r, rest // 2 AS two FROM u, t), y AS (SELECT *, f + (row_number() OVER (ORDER BY r DESC, n DESC) <= two - sum(f) OVER ())::INT AS g FROM x)
        SELECT name, pair, side, size, (size + CASE WHEN pair IS NULL THEN 2 * g ELSE g END + CASE WHEN rest % 2 = 1 AND name = (SELECT arg_max(name, (size, name)) FROM l WHERE pair IS NULL) THEN 1 ELSE 0 END)::BIGINT AS share FROM l JOIN y ON y.unit = coalesce('p' || pair, 's' || name)""",
}
