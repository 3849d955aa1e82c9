"""Queries on contracts of levels and rows: verdicts, grids, plan trees, tokens, windows, offsets, manifests, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import text
from loomspan.operators import hierarchy
from loomspan.operators.ranking import checkpointed
from loomspan.plans.hierarchy import _RANGES, _UNITS, _gapped, _links, units
from loomspan.sources import jsonl
from loomspan.sources.tables import table

_CAPTION = "CASE WHEN id % 41 = 0 THEN 'unknown' ELSE 'unit ' || id END"
_SOURCE = "CASE WHEN level = 0 AND id % 53 = 0 THEN 'auto' ELSE 'segment' END"


def level_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each level of an episode, the first unit by time that breaks a rule, and the rule; no row where all hold."""
    own = units(spark, sf_dir).withColumn("end", F.expr("CASE WHEN id % 89 = 0 THEN end + 40 ELSE end END"))
    # some units come twice, made in one pass
    own = own.withColumn("__copy", F.explode(F.expr("CASE WHEN id % 97 = 0 THEN array(0, 1) ELSE array(0) END"))).drop("__copy").select("*", F.expr(_CAPTION).alias("caption"), F.expr(_SOURCE).alias("source"))
    return hierarchy.verdicts(own, F.lit(2380), 2)


def grid_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors on one grid of each episode where its units are labelled, and one forced into the last unit if the grid misses it."""
    own = checkpointed(units(spark, sf_dir))
    return hierarchy.grid_anchors(own, _gapped(spark, sf_dir, own), 1, 20)


def plan_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode's units of level 1 with those of level 0 in them, in order of time, as one line."""
    return hierarchy.plan_lines(units(spark, sf_dir), 1, 0).select("episode", F.md5("plan").alias("plan_md5"), "n_units")


_TOLD = "CASE turn % 3 WHEN 0 THEN 'Expected action: ' || role || ' -> Actual: late -> x' WHEN 1 THEN role || ' -> ' || turn ELSE role END"


def told_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was expected and what happened, from one line; null where it has no arrow."""
    parts = F.split("told", " -> ", 2)
    side = lambda k, name: F.when(F.size(parts) == 2, F.trim(F.regexp_replace(F.get(parts, k), rf"(?i)^\s*{name}\s*:\s*", "")))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_TOLD).alias("told"))
    return said.select("conv_id", "turn", side(0, r"expected(\s+action)?").alias("expected"), side(1, r"actual(\s+failure)?").alias("actual"))


def caption_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct forms of the words of every part's name."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.caption_forms(F.concat("p_name", F.lit("_boxes making-it the"), F.col("p_brand")))), ",").alias("forms"))


def clip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, end, frames and seconds of clips cut out of recordings of known or unknown length."""
    total = F.when(F.col("l_linenumber") == 3, 0).otherwise(F.col("l_partkey") % 200)
    start = F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_suppkey") % 90 - 10)
    end = F.when(F.col("l_linenumber") == 2, None).otherwise(F.col("l_quantity").cast("long") * 5)
    first = F.greatest(F.lit(0), F.coalesce(start, F.lit(0)))
    known = total > 0
    first = F.when(known, F.least(first, total)).otherwise(first)
    last = F.greatest(first, F.coalesce(end, total))
    last = F.when(known, F.least(last, total)).otherwise(last)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", first.cast("long").alias("first"), last.cast("long").alias("last"))
    return lines.select("*", F.round(F.when(F.col("last") > F.col("first"), (F.col("last") - F.col("first")) / 25.0).otherwise(9.5), 6).alias("seconds"))


def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn's text begins and ends when a conversation's texts are laid end to end."""
    turns = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.sum(n).over(turns) - n).alias("begin"), F.sum(n).over(turns).alias("finish"))


def episode_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, kinds and extremes of every user's events."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("cases"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")
    )


def manifest_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its owner and number of items, and whether all is there."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 5").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_items"))
    owners = table(spark, sf_dir, "customer").where("c_acctbal > -500").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(owners, "o_custkey", "left").join(lines, "o_orderkey", "left")
    return joined.select("o_orderkey", "c_name", F.coalesce("n_items", F.lit(0)).alias("n_items"), (F.col("c_name").isNotNull() & F.col("n_items").isNotNull()).alias("ready"))


def json_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines in eight buckets, with lines that are cut off among them, and read back: rows, users and sums of each."""
    path = jsonl.shared_path(spark)
    own = table(spark, sf_dir, "events")
    jsonl.write_buckets(own.select("event_id", "user_id", "value", "props"), F.col("user_id").cast("string"), 8, path)
    # lines that a writer has cut off
    own.where("event_id % 50 = 0").select(F.concat(F.lit('{"event_id":'), "event_id", F.lit(',"val')).alias("value"), jsonl.shard_of(F.col("user_id").cast("string"), 8).alias("bucket")).write.mode("append").partitionBy("bucket").text(path)
    rows = jsonl.read_lines(spark, path, "event_id long, user_id long, value double, props string, bucket int")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("total"), F.count("broken").alias("n_broken"), F.min("props").alias("first_props"))


QUERIES = {f.__name__: f for f in (level_verdicts, grid_anchors, plan_trees, told_parts, caption_tokens, clip_windows, running_offsets, episode_inventory, manifest_ready, json_buckets)}

_FORMS = r"""
    w AS (SELECT p_partkey, unnest(list_distinct(regexp_extract_all(lower(replace(replace(p_name || '_boxes making-it the' || p_brand, '_', ' '), '-', ' ')), '[a-z0-9]+'))) AS t FROM part),
    s AS (SELECT * FROM w WHERE t NOT IN ('a', 'an', 'and', 'at', 'by', 'do', 'for', 'from', 'in', 'into', 'of', 'on', 'the', 'to', 'with', 'vr', 'master', 'slave', 'mode')),
    f AS (SELECT p_partkey, unnest([t, CASE t WHEN 'boxes' THEN 'box' WHEN 'folding' THEN 'fold' WHEN 'lemonade' THEN 'lemon' WHEN 'making' THEN 'make' WHEN 'packaging' THEN 'package' WHEN 'scallions' THEN 'scallion' END,
        CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 4 AND t LIKE '%es' THEN t[:-3] WHEN length(t) > 3 AND t LIKE '%s' THEN t[:-2] END,
        CASE WHEN length(t) > 5 AND t LIKE '%ing' THEN t[:-4] END]) AS t FROM s)"""
ORACLES = {
    "level_verdicts": f"""
        WITH {_UNITS}, x AS (SELECT e, lev, id, s, CASE WHEN id % 89 = 0 THEN t + 40 ELSE t END AS t FROM u), c AS (SELECT e, lev AS level, id, s, t, lag(t) OVER (PARTITION BY e, lev ORDER BY s, t) AS before FROM (FROM x UNION ALL FROM x WHERE id % 97 = 0)),
        d AS (SELECT *, count(*) OVER (PARTITION BY e, level, id) AS same, {_CAPTION} AS caption, {_SOURCE} AS source FROM c),
        v AS (SELECT *, CASE WHEN same > 1 THEN 'duplicate_unit_id' WHEN caption = 'unknown' THEN 'invalid_caption' WHEN s < 0 OR t <= s OR t > 2380 THEN 'interval_out_of_bounds' WHEN t - s < 2 THEN 'interval_too_short'
            WHEN s < before THEN 'same_level_overlap' WHEN level = 0 AND source NOT IN ('human_segment', 'segment') THEN 'invalid_l0_source' END AS reason FROM d)
        SELECT e AS episode, level, arg_min(id, (s, t, id)) AS unit, arg_min(reason, (s, t, id)) AS reason FROM v WHERE reason IS NOT NULL GROUP BY 1, 2""",
    "grid_anchors": f"""
        WITH {_UNITS}, {_RANGES}, l AS (SELECT e, min(s) AS a, max(t) AS z, arg_max(id, (s, t)) AS last FROM u WHERE lev = 1 GROUP BY e),
        na AS (SELECT DISTINCT e, x AS frame FROM (SELECT e, a, unnest(range(a, z, 20)) AS x FROM l) JOIN r USING (e) WHERE lo <= x AND x < hi),
        m AS (SELECT l.e, min(r.lo) AS frame FROM l JOIN r ON r.e = l.e AND r.unit = l.last GROUP BY l.e HAVING count(*) FILTER (EXISTS (SELECT 1 FROM na WHERE na.e = l.e AND r.lo <= na.frame AND na.frame < r.hi)) = 0)
        SELECT e AS episode, frame, false AS forced FROM na WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.e = na.e AND m.frame = na.frame) UNION ALL SELECT e, frame, true FROM m""",
    "plan_trees": f"""
        WITH {_UNITS}, c AS (SELECT e, pid, string_agg(id::VARCHAR, ',' ORDER BY s, t, id) AS ch FROM {_links(1, 0)} WHERE np >= 1 GROUP BY e, pid),
        p AS (SELECT u.e, string_agg(u.id || '[' || coalesce(ch, '') || ']', ' ' ORDER BY s, t, u.id) AS plan, count(*) AS n_units FROM u LEFT JOIN c ON c.e = u.e AND c.pid = u.id WHERE lev = 1 GROUP BY u.e)
        SELECT e AS episode, md5(plan) AS plan_md5, n_units FROM p""",
    "told_parts": rf"""
        WITH t AS (SELECT conv_id, turn, {_TOLD} AS told FROM conversations), p AS (SELECT *, instr(told, ' -> ') AS k FROM t)
        SELECT conv_id, turn, CASE WHEN k > 0 THEN trim(regexp_replace(substr(told, 1, k - 1), '^\s*expected(\s+action)?\s*:\s*', '', 'i')) END AS expected,
               CASE WHEN k > 0 THEN trim(regexp_replace(substr(told, k + 4), '^\s*actual(\s+failure)?\s*:\s*', '', 'i')) END AS actual FROM p""",
    "caption_tokens": f"WITH {_FORMS} SELECT p_partkey, string_agg(DISTINCT t, ',' ORDER BY t) AS forms FROM f WHERE t IS NOT NULL GROUP BY 1",
    "clip_windows": """
        WITH c AS (SELECT *, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_partkey % 200 END AS total, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_suppkey % 90 - 10 END AS st, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity::BIGINT * 5 END AS en FROM lineitem),
        d AS (SELECT *, CASE WHEN total > 0 THEN least(greatest(0, coalesce(st, 0)), total) ELSE greatest(0, coalesce(st, 0)) END AS f FROM c),
        e AS (SELECT *, CASE WHEN total > 0 THEN least(greatest(f, coalesce(en, total)), total) ELSE greatest(f, coalesce(en, total)) END AS l FROM d)
        SELECT l_orderkey, l_linenumber, l_suppkey, f::BIGINT AS first, l::BIGINT AS last, round(CASE WHEN l > f THEN (l - f) / 25.0 ELSE 9.5 END, 6) AS seconds FROM e""",
    "running_offsets": """
        SELECT conv_id, turn, (sum(coalesce(length(text), 0)) OVER w - coalesce(length(text), 0))::BIGINT AS begin, (sum(coalesce(length(text), 0)) OVER w)::BIGINT AS finish
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
    "episode_inventory": """SELECT user_id, count(*) AS cases, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1""",
    "manifest_ready": """
        WITH l AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 5 GROUP BY 1)
        SELECT o_orderkey, c_name, coalesce(n, 0) AS n_items, c_name IS NOT NULL AND n IS NOT NULL AS ready FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > -500 LEFT JOIN l USING (o_orderkey)""",
    "json_buckets": """
        SELECT (('0x' || substr(sha256(user_id::VARCHAR), 1, 16))::UBIGINT % 8)::INT AS bucket, count(*) + count(*) FILTER (event_id % 50 = 0) AS n, count(DISTINCT user_id) AS n_users, round(sum(value), 4) AS total,
            count(*) FILTER (event_id % 50 = 0) AS n_broken, min(props) AS first_props FROM events GROUP BY 1""",
}
