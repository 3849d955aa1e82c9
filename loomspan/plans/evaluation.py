"""Queries on evaluation rows: decisions, offsets, stability, paired contexts, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import text
from loomspan.operators import metrics
from loomspan.sources.tables import table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evaluation rows: users are episodes, event ids are frames, one of three contexts each; purchases are ends, and a large value says so."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode"), F.col("event_id").alias("frame"), F.expr("cast(event_id % 3 as int)").alias("context"), (F.col("event_type") == "purchase").alias("is_end"),
        (F.col("value") > 60).alias("says_end"), (F.col("event_id") % 5 != 0).alias("valid"), F.floor("value").cast("long").alias("score"), "event_type",
    )


def end_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends said and true by context."""
    return metrics.decision_rates(_rows(spark, sf_dir), ["context"], F.col("says_end"), F.col("is_end"), F.col("valid"))


def end_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the first valid end is before or behind the true one, by episode and context."""
    return metrics.first_offsets(_rows(spark, sf_dir), ["episode", "context"], "frame", F.col("says_end") & F.col("valid"), F.col("is_end"))


def terminal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, premature and missed ends by kind of user."""
    return metrics.terminal_rates(_rows(spark, sf_dir).withColumn("kind", F.expr("cast(episode % 4 as int)")), ["kind"], F.col("says_end"), F.col("is_end"))


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falls and steps of the score between valid neighbours of an episode."""
    return metrics.adjacent(_rows(spark, sf_dir), ["episode"], ["frame"], "score", "valid")


def memory_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an episode's event is the one remembered from the row before."""
    own = metrics.steps(_rows(spark, sf_dir), ["episode"], ["frame"], "event_type")
    return metrics.copies(own.where("valid"), ["context"], F.col("event_type"), F.col("before"))


def duplicate_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an hour's events that repeat another one of it."""
    own = table(spark, sf_dir, "events").select(F.hour("ts").alias("hour"), "event_type", "user_id")
    return metrics.duplicate_rate(own, ["hour"], text.normalised(F.concat_ws(" ", "event_type", "user_id")))


def assist_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional events of all rows, counted together."""
    own = _rows(spark, sf_dir).select(F.when(F.col("says_end"), "end_said").alias("a"), F.when(~F.col("valid"), "invalid").alias("b"), F.when(F.col("score") > 90, "high").alias("c"))
    return metrics.event_counts(own, ["a", "b", "c"])


def failure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without language as failures by length class, with the first three of each."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select((F.length(F.col("n_chars").cast("string"))).cast("int").alias("digits"), (F.col("lang") == "en").alias("english"), F.col("doc_id").cast("string").alias("episode"), "source")
    return metrics.failures(docs.where("english or english is null").select("digits", "episode", "source"), ["digits"], "episode", "source")


def context_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of an episode's score between two contexts, by kind of event; of several rows of a key the last counts."""
    own = _rows(spark, sf_dir).withColumn("slot", F.expr("frame div 50"))
    deltas = metrics.paired_deltas(own, ["episode", "event_type", "slot"], "context", 0, 1, "score", ["frame"])
    return deltas.groupBy("event_type").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("delta"), 6).alias("mean_delta"))


def episode_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean difference of each episode, and one row of all episodes' mean."""
    own = _rows(spark, sf_dir).withColumn("slot", F.expr("frame div 50"))
    deltas = metrics.paired_deltas(own, ["episode", "slot"], "context", 0, 1, "score", ["frame"])
    means = deltas.groupBy("episode").agg(F.avg("delta").alias("m"))
    return means.agg(F.count(F.lit(1)).alias("episodes"), F.round(F.avg("m"), 6).alias("mean_delta"), F.count_if(F.col("m") > 0).alias("better"), F.count_if(F.col("m") < 0).alias("worse"))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected documents and characters by source, with totals."""
    docs = table(spark, sf_dir, "documents").select("source", F.when(F.col("n_chars") >= 200, "accepted").otherwise("rejected").alias("status"), "n_chars")
    return docs.rollup("source", "status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("status") == "accepted", F.col("n_chars"))), F.lit(0)).alias("samples"), F.grouping_id().cast("long").alias("level"))


def score_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each context with its interval by bootstrap."""
    return metrics.mean_interval(_rows(spark, sf_dir), ["context"], F.col("score"), 200)


QUERIES = {f.__name__: f for f in (end_decisions, end_offsets, terminal_rates, stability, memory_copies, duplicate_rates, assist_counts, failure_groups, context_deltas, episode_deltas, status_rollup, score_interval)}

_ROWS = """r AS (SELECT user_id AS episode, event_id AS frame, (event_id % 3)::INT AS context, event_type = 'purchase' AS is_end, value > 60 AS says_end, event_id % 5 <> 0 AS valid, floor(value)::BIGINT AS score, event_type FROM events)"""
_LAST = "d AS (SELECT {keys}, arg_max(score, frame) FILTER (context = 0) - arg_max(score, frame) FILTER (context = 1) AS delta FROM (SELECT *, frame // 50 AS slot FROM r) GROUP BY ALL)"
ORACLES = {
    "end_decisions": f"""
        WITH {_ROWS} SELECT context, count(*) FILTER (says_end AND is_end) AS tp, count(*) FILTER (says_end AND NOT is_end) AS fp, count(*) FILTER (NOT says_end AND is_end) AS fn, count(*) FILTER (NOT says_end AND NOT is_end) AS tn,
               round(avg(CASE WHEN valid THEN says_end = is_end ELSE false END::INT), 6) AS strict_accuracy FROM r GROUP BY 1""",
    "end_offsets": f"""
        WITH {_ROWS} SELECT episode, context, min(frame) FILTER (says_end AND valid) - max(frame) FILTER (is_end) AS "offset" FROM r GROUP BY 1, 2 HAVING count(*) FILTER (is_end) > 0""",
    "terminal_rates": f"""
        WITH {_ROWS}, n AS (SELECT (episode % 4)::INT AS kind, count(*) FILTER (says_end AND is_end) AS tp, count(*) FILTER (says_end AND NOT is_end) AS fp, count(*) FILTER (NOT says_end AND is_end) AS fn, count(*) FILTER (NOT says_end AND NOT is_end) AS tn FROM r GROUP BY 1)
        SELECT kind, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS premature, round(coalesce(fn / nullif(tp + fn, 0), 0), 6) AS missed FROM n""",
    "stability": f"""
        WITH {_ROWS}, p AS (SELECT episode, score - lag(score) OVER w AS step, valid AND lag(valid) OVER w AS ok FROM r WINDOW w AS (PARTITION BY episode ORDER BY frame))
        SELECT episode, count(*) AS pairs, count(*) FILTER (step < 0) AS regressions, round(avg(abs(step)), 6) AS residual FROM p WHERE ok GROUP BY 1""",
    "memory_copies": f"""
        WITH {_ROWS}, p AS (SELECT *, lag(event_type) OVER (PARTITION BY episode ORDER BY frame) AS m FROM r)
        SELECT context, count(*) AS comparable, count(*) FILTER (event_type = m) AS copied, round(avg((event_type = m)::INT), 6) AS rate FROM p WHERE valid AND m IS NOT NULL GROUP BY 1""",
    "duplicate_rates": "SELECT hour(ts)::INT AS hour, round((count(*) - count(DISTINCT event_type || ' ' || user_id)) / count(*), 6) AS rate FROM events GROUP BY 1",
    "assist_counts": f"""
        WITH {_ROWS} SELECT event, count(*) AS n FROM (SELECT 'end_said' AS event FROM r WHERE says_end UNION ALL SELECT 'invalid' FROM r WHERE NOT valid UNION ALL SELECT 'high' FROM r WHERE score > 90) GROUP BY 1""",
    "failure_groups": """
        WITH f AS (SELECT length(n_chars::VARCHAR)::INT AS digits, doc_id::VARCHAR AS episode, source FROM documents WHERE doc_id IS NOT NULL AND (lang = 'en' OR lang IS NULL))
        SELECT digits, count(*) AS n, count(DISTINCT episode) AS episodes, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT episode))[1:3], ',') AS representatives FROM f GROUP BY 1""",
    "context_deltas": f"WITH {_ROWS}, {_LAST.format(keys='episode, event_type, slot')} SELECT event_type, count(*) AS pairs, round(avg(delta), 6) AS mean_delta FROM d WHERE delta IS NOT NULL GROUP BY 1",
    "episode_deltas": f"""
        WITH {_ROWS}, {_LAST.format(keys='episode, slot')}, m AS (SELECT episode, avg(delta) AS m FROM d WHERE delta IS NOT NULL GROUP BY 1)
        SELECT count(*) AS episodes, round(avg(m), 6) AS mean_delta, count(*) FILTER (m > 0) AS better, count(*) FILTER (m < 0) AS worse FROM m""",
    "status_rollup": """
        WITH d AS (SELECT source, CASE WHEN n_chars >= 200 THEN 'accepted' ELSE 'rejected' END AS status, n_chars FROM documents)
        SELECT source, status, count(*) AS n, coalesce(sum(n_chars) FILTER (status = 'accepted'), 0)::BIGINT AS samples, grouping(source, status) AS level FROM d GROUP BY ROLLUP (source, status)""",
}
