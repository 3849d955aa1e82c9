"""Queries on exposure totals, and on anchors and picks of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import allocate, sampling
from loomspan.sources.tables import table


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def fixed_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,001 exposures over kinds of events, a fifth of them for purchases."""
    return allocate.with_quota(_kinds(spark, sf_dir), "event_type", "n", 1001, "purchase", 20)


def least_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least total, in steps of 200, that covers three kinds of events at 70, 15 and 15 %."""
    return allocate.least_total(_kinds(spark, sf_dir), "event_type", "n", {"view": 70, "click": 15, "error": 15}, 200)


def above_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100,000 exposures over kinds of events, a hundred at least for each."""
    return allocate.above_minimum(_kinds(spark, sf_dir).withColumn("least", F.lit(100).cast("long")), "event_type", "n", "least", 100_000)


def mix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most that keeps the weights of the kinds without a repeat."""
    return allocate.mix_budget(_kinds(spark, sf_dir).withColumn("w", F.length("event_type") / 40.0), "n", "w")


def quantile_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at five places of the order by length."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "n_chars")
    return sampling.at_positions(docs, ["n_chars", "doc_id"], [f"(last * {k} + 2) div 4" for k in range(5)]).select("doc_id", "n_chars", F.col("rank").cast("long").alias("rank"))


def boundary_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last frame of every line item's time, and the late frames at a stride of 10."""
    start, end = F.col("l_partkey").cast("long"), (F.col("l_partkey") + F.col("l_quantity")).cast("long")
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_suppkey", F.array_join(sampling.boundary_frames(start, end), ",").alias("edges"), F.array_join(sampling.late_frames(start, end, 10), ",").alias("late"))


def context_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of history of every event, none before frame 100."""
    return table(spark, sf_dir, "events").select("event_id", F.array_join(sampling.history_frames(F.col("event_id"), [-40, -20, 0], F.lit(100)), ",").alias("frames"))


def row_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns of conversations stand in each stage."""
    own = Window.partitionBy("conv_id")
    turns = table(spark, sf_dir, "conversations").withColumns({"nth": F.row_number().over(own.orderBy("turn")) - 1, "rows": F.count(F.lit(1)).over(own)})
    return turns.groupBy(sampling.stage(F.col("nth"), F.col("rows"), F.col("nth") == F.col("rows") - 1).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last erroneous event of every user."""
    return sampling.highlights(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error")


def balanced_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters of eight workers, dealt forth and back by length."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "n_chars")
    return sampling.balanced(docs, "doc_id", "n_chars", 8).groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("load"))


QUERIES = {f.__name__: f for f in (fixed_quota, least_total, above_minimum, mix_budget, quantile_picks, boundary_frames, context_frames, row_stages, highlights, balanced_load)}

_K = "k AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)"
_SHARE = """SELECT event_type, n{more}, n * {total} // s{plus} + CASE WHEN row_number() OVER (ORDER BY n * {total} % s DESC, event_type DESC) <= {total} - sum(n * {total} // s) OVER () THEN 1 ELSE 0 END AS share"""
ORACLES = {
    "fixed_quota": f"""
        WITH {_K}, o AS (SELECT *, sum(n) OVER () AS s FROM k WHERE event_type <> 'purchase')
        SELECT event_type, n, share::BIGINT AS share FROM ({_SHARE.format(total=801, plus='', more='')} FROM o UNION ALL SELECT event_type, n, 200 FROM k WHERE event_type = 'purchase')""",
    "least_total": f"WITH {_K}, w AS (SELECT n, CASE event_type WHEN 'view' THEN 70 ELSE 15 END AS w FROM k WHERE event_type IN ('view', 'click', 'error')) SELECT ((max((n * 100 + w - 1) // w) + 199) // 200 * 200)::BIGINT AS total FROM w",
    "above_minimum": f"""
        WITH {_K}, o AS (SELECT *, sum(n) OVER () AS s, (100000 - 100 * count(*) OVER ())::BIGINT AS t FROM k)
        SELECT event_type, n, least, share::BIGINT AS share FROM ({_SHARE.format(total='t', plus=' + 100', more=', 100::BIGINT AS least')} FROM o)""",
    "mix_budget": f"WITH {_K} SELECT greatest(1, floor(min(n / (length(event_type) / 40.0))))::BIGINT AS budget FROM k",
    "quantile_picks": """
        WITH d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank, count(*) OVER () - 1 AS l FROM documents WHERE doc_id IS NOT NULL)
        SELECT doc_id, n_chars, rank FROM d WHERE rank IN (2 // 4, (l + 2) // 4, (2 * l + 2) // 4, (3 * l + 2) // 4, (4 * l + 2) // 4)""",
    "boundary_frames": """
        WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS s, (l_partkey + l_quantity)::BIGINT AS e FROM lineitem), g AS (SELECT *, s + ((e - s) * 70 + 99) // 100 AS f FROM f)
        SELECT l_orderkey, l_linenumber, l_suppkey, array_to_string(list_sort(list_distinct([s, (s + e - 1) // 2, e - 1])), ',') AS edges, CASE WHEN f < e THEN array_to_string(range(f, e, 10), ',') ELSE '' END AS late FROM g""",
    "context_frames": """
        WITH f AS (SELECT event_id, greatest(event_id - 40, 100) AS a, greatest(event_id - 20, 100) AS b, greatest(event_id, 100) AS c FROM events)
        SELECT event_id, a || CASE WHEN b <> a THEN ',' || b ELSE '' END || CASE WHEN c <> b THEN ',' || c ELSE '' END AS frames FROM f""",
    "row_stages": """
        WITH t AS (SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth, count(*) OVER (PARTITION BY conv_id) AS rows FROM conversations)
        SELECT CASE WHEN nth = rows - 1 THEN 'terminal' WHEN nth = 0 THEN 'initial' WHEN nth * 4 < rows THEN 'start' ELSE 'process' END AS stage, count(*) AS n FROM t GROUP BY 1""",
    "highlights": """
        WITH t AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth, count(*) OVER (PARTITION BY user_id) AS c FROM events)
        SELECT user_id, min(event_id) AS first, max(event_id) FILTER (nth = c // 2) AS middle, max(event_id) FILTER (event_type = 'error') AS last_terminal FROM t GROUP BY 1""",
    "balanced_load": """
        WITH d AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents WHERE doc_id IS NOT NULL)
        SELECT (CASE WHEN r // 8 % 2 = 0 THEN r % 8 ELSE 7 - r % 8 END)::INT AS worker, count(*) AS n, sum(n_chars)::BIGINT AS load FROM d GROUP BY 1""",
}
