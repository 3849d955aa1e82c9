"""Queries on plans that are aligned caption by caption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import alignment
from loomspan.sources.tables import table

_SAID = "concat(p_name, ' ', lower(p_type), case when l_linenumber % 3 = 0 then ' and ' || p_name else '' end)"
_MEANT = "concat(case when l_returnflag = 'R' then 'old ' else '' end, p_name, case when l_linestatus = 'O' then ' ...' else ' ' || lower(p_type) end)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_name", "p_type")
    return table(spark, sf_dir, "lineitem").join(parts, "l_partkey").selectExpr("*", f"{_SAID} AS said", f"{_MEANT} AS meant")


def _ordered(values: Column, *order: str) -> Column:
    """Values that are not null, by the order's columns."""
    held = F.collect_list(F.when(values.isNotNull(), F.struct(*order, values.alias("v"))))
    return F.transform(F.array_sort(held), lambda x: x["v"])


_BY_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_BY_DATE = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, what is said of its lines by number, and what is meant by those of some quantity by date."""
    return _lines(spark, sf_dir).groupBy("l_orderkey").agg(_ordered(F.col("said"), *_BY_LINE).alias("said"), _ordered(F.when(F.col("l_quantity") > 10, F.col("meant")), *_BY_DATE).alias("meant"))


def caption_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every order by number against those by date."""
    a = F.col("alignment")
    pairs = F.array_join(F.transform(a["matches"], lambda m: F.concat_ws("-", m["predicted"], m["target"])), " ")
    return alignment.caption_alignment(_plans(spark, sf_dir), "said", "meant").select(
        "l_orderkey", a["n_predicted"].alias("n_predicted"), a["n_target"].alias("n_target"), *(F.round(a[c], 6).alias(c) for c in ("total", "score", "coverage", "extra")), pairs.alias("pairs")
    )


def plan_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders with their lines as a plan, by key, against those of some value by date."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "lower(concat(o_orderpriority, ' ', o_orderstatus)) AS called")
    both = orders.join(_plans(spark, sf_dir), "l_orderkey")
    plan = lambda segments: F.struct(F.col("called").alias("caption"), F.col(segments).alias("segments"))
    plans = both.groupBy("o_custkey").agg(_ordered(plan("said"), "l_orderkey").alias("predicted"), _ordered(F.when(F.col("o_totalprice") > 100_000, plan("meant")), "o_orderdate", "l_orderkey").alias("target"))
    p = F.col("plan")
    return alignment.plan_alignment(plans.withColumn("fits", F.col("o_custkey") % 5 != 0), "predicted", "target", "fits").select(
        "o_custkey", *(p[c].alias(c) for c in ("n_predicted", "n_target", "n_segments", "n_target_segments")),
        *(F.round(p[c], 6).alias(c) for c in ("total", "score", "coverage", "extra", "repeated_actions", "repeated_segments", "segment_score", "segment_coverage", "strict_score")),
    )


QUERIES = {f.__name__: f for f in (caption_alignment, plan_alignment)}


def _aligned(x: str) -> str:
    """Steps that align the captions of {x}_l (k, i, cap) and {x}_r (k, j, cap), places from 1, for each k of {x}_k: {x}_m has the matches, {x}_o the sums.

    The table of sums is made row by row, then the choices are followed from its end.
    """
    return rf"""
    {x}_lt AS (SELECT k, i, t, count(*) AS c FROM (SELECT k, i, unnest(regexp_extract_all(lower(cap), '[a-z0-9]+')) AS t FROM {x}_l) GROUP BY ALL),
    {x}_rt AS (SELECT k, j, t, count(*) AS c FROM (SELECT k, j, unnest(regexp_extract_all(lower(cap), '[a-z0-9]+')) AS t FROM {x}_r) GROUP BY ALL),
    {x}_ls AS (SELECT k, i, coalesce(sum(c), 0)::DOUBLE AS n FROM {x}_l LEFT JOIN {x}_lt USING (k, i) GROUP BY ALL), {x}_rs AS (SELECT k, j, coalesce(sum(c), 0)::DOUBLE AS n FROM {x}_r LEFT JOIN {x}_rt USING (k, j) GROUP BY ALL),
    {x}_both AS (SELECT k, i, j, sum(least(a.c, b.c))::DOUBLE AS o FROM {x}_lt a JOIN {x}_rt b USING (k, t) GROUP BY ALL),
    {x}_f AS (SELECT k, i, j, CASE WHEN a.n = 0 AND b.n = 0 THEN 1.0::DOUBLE WHEN o IS NULL THEN 0.0::DOUBLE ELSE 2 * (o / a.n) * (o / b.n) / (o / a.n + o / b.n) END AS f FROM {x}_ls a JOIN {x}_rs b USING (k) LEFT JOIN {x}_both USING (k, i, j)),
    {x}_n AS (SELECT k, (SELECT count(*) FROM {x}_l l WHERE l.k IS NOT DISTINCT FROM q.k) AS n, (SELECT count(*) FROM {x}_r r WHERE r.k IS NOT DISTINCT FROM q.k) AS m FROM {x}_k q),
    {x}_row AS (SELECT k, i, list(f ORDER BY j) AS f FROM {x}_f GROUP BY k, i),
    {x}_s(k, i, s, b, f) AS (
        SELECT k, 0::BIGINT, list_transform(range(m + 1), lambda z: 0.0::DOUBLE), NULL::DOUBLE[], NULL::DOUBLE[] FROM {x}_n
        UNION ALL
        SELECT k, i, list_transform(range(1, len(b) + 1), lambda j: list_max(b[1:j])), b, f FROM (
            SELECT p.k, p.i + 1 AS i, w.f, list_prepend(0.0::DOUBLE, list_transform(range(1, len(w.f) + 1), lambda j: greatest(p.s[j + 1], CASE WHEN w.f[j] > 0 THEN p.s[j] + w.f[j] ELSE 0 END))) AS b
            FROM {x}_s p JOIN {x}_row w ON w.k = p.k AND w.i = p.i + 1)),
    {x}_g(k, i, j, how) AS (
        SELECT k, n, m, -1 FROM {x}_n
        UNION ALL
        SELECT k, i - (how <> 0)::INT, j - (how <> 1)::INT, how FROM (
            SELECT g.k, g.i, g.j, CASE WHEN c.f[g.j] > 0 AND b.s[g.j] + c.f[g.j] = c.s[g.j + 1] THEN 2 WHEN b.s[g.j + 1] = c.s[g.j + 1] THEN 1 ELSE 0 END AS how
            FROM {x}_g g JOIN {x}_s c ON c.k = g.k AND c.i = g.i JOIN {x}_s b ON b.k = g.k AND b.i = g.i - 1 WHERE g.i > 0 AND g.j > 0)),
    {x}_m AS (SELECT k, e.i, e.j, e.f FROM {x}_g g JOIN {x}_f e USING (k) WHERE how = 2 AND e.i = g.i + 1 AND e.j = g.j + 1),
    {x}_o AS (SELECT q.k, any_value(q.n) AS n, any_value(q.m) AS m, any_value(coalesce(s.s[q.m + 1], 0)) AS total, count(z.f) FILTER (z.f >= 0.5) AS ok, coalesce(string_agg((z.i - 1) || '-' || (z.j - 1), ' ' ORDER BY z.i), '') AS pairs
        FROM {x}_n q LEFT JOIN {x}_s s ON s.k = q.k AND s.i = CASE WHEN q.m > 0 THEN q.n ELSE 0 END LEFT JOIN {x}_m z ON z.k = q.k GROUP BY q.k)"""


_LINES = f"""lines AS (SELECT l_orderkey, {_SAID} AS said, CASE WHEN l_quantity > 10 THEN {_MEANT} END AS meant,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_BY_LINE)}) AS i,
        row_number() OVER (PARTITION BY l_orderkey, l_quantity > 10 ORDER BY {", ".join(_BY_DATE)}) AS j FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_REPEATED = lambda table, cap: f"SELECT k, (count(*) - count(DISTINCT trim(regexp_replace(lower({cap}), '\\s+', ' ', 'g'))))::DOUBLE / count(*) AS r FROM {table} GROUP BY k"
ORACLES = {
    "caption_alignment": f"""
        WITH RECURSIVE {_LINES}, a_k AS (SELECT DISTINCT l_orderkey AS k FROM lines),
        a_l AS (SELECT l_orderkey AS k, i, said AS cap FROM lines), a_r AS (SELECT l_orderkey AS k, j, meant AS cap FROM lines WHERE meant IS NOT NULL), {_aligned("a")}
        SELECT k AS l_orderkey, n::INT AS n_predicted, m::INT AS n_target, round(total, 6) AS total, round(total / greatest(n, m, 1), 6) AS score, round(ok / greatest(m, 1), 6) AS coverage, round((n - ok) / greatest(n, 1), 6) AS extra, pairs FROM a_o""",
    "plan_alignment": f"""
        WITH RECURSIVE {_LINES}, held AS (SELECT DISTINCT l_orderkey FROM lines),
        o AS (SELECT o_custkey AS k, o_orderkey, lower(o_orderpriority || ' ' || o_orderstatus) AS cap, o_totalprice > 100000 AS wanted, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i,
            row_number() OVER (PARTITION BY o_custkey, o_totalprice > 100000 ORDER BY o_orderdate, o_orderkey) AS j FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM held)),
        a_k AS (SELECT DISTINCT k FROM o), a_l AS (SELECT k, i, cap FROM o), a_r AS (SELECT k, j, cap FROM o WHERE wanted), {_aligned("a")},
        pair AS (SELECT a_m.k AS c, a_m.k || ':' || a_m.i AS k, p.o_orderkey AS po, t.o_orderkey AS tk FROM a_m JOIN o p ON p.k = a_m.k AND p.i = a_m.i JOIN o t ON t.k = a_m.k AND t.j = a_m.j AND t.wanted),
        b_k AS (SELECT k FROM pair), b_l AS (SELECT k, i, said AS cap FROM pair JOIN lines ON l_orderkey = po), b_r AS (SELECT k, j, meant AS cap FROM pair JOIN lines ON l_orderkey = tk WHERE meant IS NOT NULL), {_aligned("b")},
        seg AS (SELECT c, sum(n) AS ns, sum(m) AS nt, avg(total / greatest(n, m, 1)) AS sc, avg(ok / greatest(m, 1)) AS co FROM b_o JOIN pair USING (k) GROUP BY c),
        ra AS ({_REPEATED("a_l", "cap")}), rs AS ({_REPEATED("(SELECT c AS k, b_l.cap FROM b_l JOIN pair USING (k))", "cap")})
        SELECT a_o.k AS o_custkey, n::INT AS n_predicted, m::INT AS n_target, coalesce(ns, 0)::INT AS n_segments, coalesce(nt, 0)::INT AS n_target_segments, round(total, 6) AS total, round(total / greatest(n, m, 1), 6) AS score,
            round(ok / greatest(m, 1), 6) AS coverage, round((n - ok) / greatest(n, 1), 6) AS extra, round(ra.r, 6) AS repeated_actions, round(coalesce(rs.r, 0), 6) AS repeated_segments,
            round(coalesce(sc, 0), 6) AS segment_score, round(coalesce(co, 0), 6) AS segment_coverage, CASE WHEN a_o.k % 5 <> 0 THEN round(total / greatest(n, m, 1), 6) ELSE 0 END AS strict_score
        FROM a_o JOIN ra ON ra.k = a_o.k LEFT JOIN seg ON seg.c = a_o.k LEFT JOIN rs ON rs.k = a_o.k""",
}
