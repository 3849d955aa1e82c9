"""Queries on anchors, history and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import progress
from loomspan.functions.times import day_number
from loomspan.operators import sampling
from loomspan.sources.tables import table


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stride and quantile anchors of each order's interval, with its progress there."""
    start = day_number("o_orderdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", start.alias("start"), (start + F.col("o_orderkey") % 60).alias("end"))
    out = sampling.anchors(orders, "start", "end", 10, [0.25, 0.5, 0.75])
    place = (F.col("anchor"), F.col("start"), F.col("end"))
    return out.select("o_orderkey", "anchor", progress.interval_progress(*place).alias("progress"), progress.last_frame_progress(*place).alias("last_progress"))


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The up to 8 turns before each turn, and the state of the one before it."""
    turns = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.collect_list("text").over(turns.rowsBetween(-8, -1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.array_join(before, " | ")).alias("history_md5"), F.size(before).cast("long").alias("n_history"), F.lag("role").over(turns).alias("before_role"))


def bottom_k_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents of least seeded hash in each language and source."""
    return sampling.bottom_k(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 5).select("lang", "source", "doc_id", F.col("nth").cast("long").alias("nth"))


def duration_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of the documents by length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sampling.rank_strata(docs, ["n_chars", "doc_id"], 4).select("doc_id", "stratum")


QUERIES = {f.__name__: f for f in (anchors, history_window, bottom_k_cells, duration_strata)}
ORACLES = {
    "anchors": """
        WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + o_orderkey % 60 AS e FROM orders),
        a AS (SELECT o_orderkey, s, e, unnest(generate_series(s, e - 1, 10)) AS anchor FROM o WHERE e > s
              UNION SELECT o_orderkey, s, e, s + floor((e - s - 1) * q)::BIGINT FROM o, (VALUES (0.25), (0.5), (0.75)) t(q) WHERE e > s)
        SELECT o_orderkey, anchor, round_even((anchor - s)::DOUBLE / (e - s) * 100, 0)::INT AS progress,
               round_even(least(1.0, (anchor - s)::DOUBLE / greatest(e - s - 1, 1)) * 100, 0)::INT AS last_progress
        FROM a""",
    "history_window": """
        SELECT conv_id, turn, md5(coalesce(string_agg(text, ' | ') OVER w8, '')) AS history_md5, count(text) OVER w8 AS n_history, lag(role) OVER w AS before_role
        FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text), w8 AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""",
    "bottom_k_cells": """
        SELECT lang, source, doc_id, nth FROM (
          SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('42' || chr(0) || doc_id), doc_id) AS nth FROM documents) WHERE nth <= 5""",
    "duration_strata": """
        SELECT doc_id, least(3, ((row_number() OVER (ORDER BY n_chars, doc_id) - 1) * 4) // count(*) OVER ())::INT AS stratum FROM documents""",
}
