"""Queries on allocation, errors, overlap and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import allocate, metrics
from loomspan.sources.tables import table

_ORDER = ["ts", "event_id"]


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def largest_remainder_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 exposures dealt to the event types by their counts; ties to the first name."""
    return allocate.largest_remainder(_counts(spark, sf_dir), "event_type", "n", 1000)


def largest_remainder_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above for 997; ties to the last name."""
    return allocate.largest_remainder(_counts(spark, sf_dir), "event_type", "n", 997, last_name_first=True)


def replay_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes over each language's documents until two and a half times its number is taken."""
    leaves = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    return allocate.replay(leaves.withColumn("wanted", F.expr("size * 5 div 2")), "wanted", "size").select("lang", "pass", "take")


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's rounded value against that of the user's event before it."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", F.floor("value").alias("v"))
    return metrics.steps(events, ["user_id"], _ORDER, "v")


def progress_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro and macro mean error by user; a missing prediction counts 100."""
    score = F.when(F.col("before").isNotNull(), F.abs(F.col("v") - F.col("before"))).otherwise(100)
    out = metrics.micro_macro(_errors(spark, sf_dir), "user_id", score)
    return out.select("n_rows", F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring events of a user, and those whose value falls."""
    pairs = _errors(spark, sf_dir).where("before is not null")
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("v") < F.col("before")).alias("n_regressions"), F.max(F.col("before") - F.col("v")).alias("worst"))


def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the errors by event type."""
    return metrics.error_summary(_errors(spark, sf_dir), "event_type", F.col("v") - F.col("before"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length as a rule for quality, against the labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where("quality is not null")
    both = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id")
    return metrics.confusion(both, F.col("n_chars") >= 500, F.col("quality") == 1)


def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token overlap of each turn with the next of its conversation."""
    turns = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    both = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(turns).alias("answer"), F.row_number().over(turns).cast("long").alias("nth"), F.lead("role").over(turns).alias("has"))
    return metrics.token_f1(both.where("has is not null"), ["conv_id", "nth"], "text", "answer")


def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user and day, the last view's value minus the last click's."""
    events = table(spark, sf_dir, "events").withColumns({"day": F.col("ts").cast("date").cast("string"), "cents": F.round(F.col("value") * 100).cast("long")})
    return metrics.paired_deltas(events, ["user_id", "day"], "event_type", "view", "click", "cents", _ORDER)


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the number in their properties."""
    events = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "user_id")
    return events.groupBy("k").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_users"))


def topk_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent event types."""
    return _counts(spark, sf_dir).orderBy(F.desc("n"), "event_type").limit(3)


def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the shipped line items by return flag and status."""
    items = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    dec = lambda c: F.col(c).cast("decimal(15,2)")
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(dec("l_quantity")).cast("double").alias("sum_qty"), F.sum(dec("l_extendedprice")).cast("double").alias("sum_price"), F.sum(dec("l_extendedprice") * (1 - dec("l_discount"))).cast("double").alias("sum_disc"), F.count(F.lit(1)).alias("n_items")
    )


def customer_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, orders and rank by nation of each customer."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice").cast("decimal(15,2)") * (1 - F.col("l_discount").cast("decimal(15,2)"))).alias("revenue"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    sums = items.join(orders, "l_orderkey").groupBy("c_custkey").agg(F.sum("revenue").alias("revenue"), F.countDistinct("l_orderkey").alias("n_orders"))
    named = sums.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    rank = Window.partitionBy("c_nationkey").orderBy(F.desc("revenue"), "c_custkey")
    return named.select("c_custkey", "c_nationkey", F.col("revenue").cast("double").alias("revenue"), "n_orders", F.row_number().over(rank).cast("long").alias("place"))


_AUDIT = "event_id % 3 AS context, user_id AS episode, event_id AS frame, event_type IN ('purchase', 'signup') AS said, event_id % 7 = 0 AS meant, event_type <> 'error' AS ok, floor(value) AS score, event_id % 4 = 0 AS same, CAST(floor(value) AS INT) - 30 AS off"


def end_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends that events tell, by context: decisions, first ends and what is said at the true ones."""
    own = table(spark, sf_dir, "events").selectExpr(*_split(_AUDIT))
    c = F.col
    return metrics.end_audit(own, ["context"], ["episode"], "frame", c("said"), c("meant"), c("ok"), c("score"), c("same"), c("off"))


def _split(text: str) -> list[str]:
    """Expressions with commas between them, but for those in brackets."""
    out, depth = [""], 0
    for part in text:
        depth += (part == "(") - (part == ")")
        if part == "," and not depth:
            out.append("")
        else:
            out[-1] += part
    return [x.strip() for x in out]


def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows, scores and the five largest falls of progress of users' events, by a third of the users."""
    own = table(spark, sf_dir, "events").selectExpr("user_id % 3 AS part", "user_id", "event_id", "ts", "event_type <> 'error' AS ok", "CAST(floor(value) AS INT) AS p", "CAST(event_id % 7 AS DOUBLE) / 9 AS c")
    out = metrics.execution_summary(own, ["part"], ["user_id"], ["ts", "event_id"], F.col("ok"), F.col("p"), F.col("c"), 5)
    return out.select("part", "rows", "valid_rate", "caption", "regressions", "falls")


QUERIES = {f.__name__: f for f in (largest_remainder_asc, largest_remainder_desc, replay_tasks, progress_error, regressions, error_summary, confusion, token_f1, paired_deltas, json_props, topk_types, price_summary, customer_revenue, end_audit, execution_summary)}


def _remainder(total: int, order: str) -> str:
    return f"""
        WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), s AS (SELECT *, sum(n) OVER ()::BIGINT AS t FROM c),
        f AS (SELECT event_type, n, n * {total} // t AS fl, n * {total} % t AS r FROM s)
        SELECT event_type, n, fl + (row_number() OVER (ORDER BY r DESC, event_type {order}) <= {total} - sum(fl) OVER ())::BIGINT AS share FROM f"""


_STEP = "SELECT user_id, event_id, event_type, floor(value)::BIGINT AS v, lag(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events"
ORACLES = {
    "end_audit": f"""
        WITH a AS (SELECT {_AUDIT} FROM events), d AS (SELECT context, count(*) FILTER (said AND meant) AS tp, count(*) FILTER (said AND NOT meant) AS fp, count(*) FILTER (NOT said AND meant) AS fn, count(*) FILTER (NOT said AND NOT meant) AS tn,
            round(avg(((CASE WHEN ok THEN said ELSE NOT meant END) = meant)::INT), 6) AS strict_accuracy FROM a GROUP BY 1),
        e AS (SELECT context, episode, max(frame) FILTER (meant) AS e, min(frame) FILTER (said AND ok) AS v, min(frame) FILTER (said) AS r FROM a GROUP BY ALL HAVING max(frame) FILTER (meant) IS NOT NULL),
        f AS (SELECT context, count(*) AS episodes, round(avg(v - e), 6) AS first_end, count(*) FILTER (v IS NULL) AS no_end, round(avg(r - e), 6) AS first_raw_end, count(*) FILTER (r IS NULL) AS no_raw_end FROM e GROUP BY 1),
        l AS (SELECT context, round(avg(CASE WHEN ok THEN score ELSE 0 END), 6) AS terminal_caption, round(avg((ok AND same)::INT), 6) AS terminal_exact, round(avg(CASE WHEN ok THEN abs(off) ELSE 100 END), 6) AS terminal_mae FROM a WHERE meant GROUP BY 1)
        SELECT * FROM d LEFT JOIN f USING (context) LEFT JOIN l USING (context)""",
    "execution_summary": """
        WITH e AS (SELECT user_id % 3 AS part, user_id, event_type <> 'error' AS ok, floor(value)::INT AS p, CAST(event_id % 7 AS DOUBLE) / 9 AS c, row_number() OVER w AS k, lag(event_type <> 'error') OVER w AS ok0, lag(floor(value)::INT) OVER w AS p0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        d AS (SELECT *, CASE WHEN ok AND ok0 THEN p - p0 END AS d FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY d, user_id, k) AS n FROM d WHERE d < 0)
        SELECT part, count(*) AS rows, round(avg(ok::INT), 6) AS valid_rate, round(avg(CASE WHEN ok THEN c ELSE 0 END), 6) AS caption, count(*) FILTER (d < 0) AS regressions,
            (SELECT string_agg(user_id || '@' || k || ':' || -d, ' ' ORDER BY n.n) FROM n WHERE n.part = d.part AND n.n <= 5) AS falls FROM d GROUP BY part""",
    "largest_remainder_asc": _remainder(1000, "ASC"),
    "largest_remainder_desc": _remainder(997, "DESC"),
    "replay_tasks": """
        WITH l AS (SELECT lang, count(*) AS size, count(*) * 5 // 2 AS wanted FROM documents GROUP BY 1), p AS (SELECT *, unnest(generate_series(1, ceil(wanted / size)::BIGINT)) AS pass FROM l)
        SELECT lang, pass, least(size, wanted - (pass - 1) * size) AS take FROM p WHERE wanted > 0""",
    "progress_error": f"""
        WITH e AS (SELECT user_id, CASE WHEN b IS NULL THEN 100 ELSE abs(v - b) END AS x FROM ({_STEP})), u AS (SELECT user_id, sum(x) AS s, count(*) AS n FROM e GROUP BY 1)
        SELECT sum(n)::BIGINT AS n_rows, round(sum(s) / sum(n), 6) AS micro, round(avg(s / n), 6) AS macro FROM u""",
    "regressions": f"SELECT user_id, count(*) AS n_pairs, count(*) FILTER (v < b) AS n_regressions, max(b - v) AS worst FROM ({_STEP}) WHERE b IS NOT NULL GROUP BY 1",
    "error_summary": f"""
        WITH e AS (SELECT event_type, v - b AS d, abs(v - b) AS a FROM ({_STEP}) WHERE b IS NOT NULL)
        SELECT event_type, count(*) AS n_errors, round(avg(a), 6) AS mae, median(a) AS median_error, quantile_disc(a, 0.9) AS p90, round(avg(d), 6) AS bias,
               round(avg((a > 10)::INT), 6) AS over_10, round(avg((a > 20)::INT), 6) AS over_20 FROM e GROUP BY 1""",
    "confusion": """
        WITH b AS (SELECT n_chars >= 500 AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
        n AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM b)
        SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced FROM n""",
    "token_f1": """
        WITH t AS (SELECT conv_id, row_number() OVER w AS nth, text, lead(text) OVER w AS answer, lead(role) OVER w AS has FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        p AS (SELECT * FROM t WHERE has IS NOT NULL),
        k AS (SELECT conv_id, nth, 0 AS side, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS token FROM p
              UNION ALL SELECT conv_id, nth, 1, unnest(regexp_extract_all(lower(coalesce(answer, '')), '[a-z0-9]+')) FROM p),
        c AS (SELECT conv_id, nth, token, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM k GROUP BY 1, 2, 3),
        s AS (SELECT conv_id, nth, sum(least(a, b)) AS common, sum(a) + sum(b) AS total FROM c GROUP BY 1, 2)
        SELECT p.conv_id, p.nth, round(CASE WHEN total IS NULL THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * common / total END, 6) AS f1 FROM p LEFT JOIN s ON p.conv_id = s.conv_id AND p.nth = s.nth""",
    "paired_deltas": """
        WITH e AS (SELECT user_id, ts::DATE::VARCHAR AS day, event_type, round(value * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY user_id, ts::DATE, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('view', 'click'))
        SELECT l.user_id, l.day, l.cents - r.cents AS delta FROM e l JOIN e r ON l.user_id = r.user_id AND l.day = r.day AND l.n = 1 AND r.n = 1 AND l.event_type = 'view' AND r.event_type = 'click'""",
    "json_props": "SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
    "topk_types": "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3",
    "price_summary": """
        SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(15,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(15,2))::DOUBLE AS sum_price,
               sum(l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(15,2)))::DOUBLE AS sum_disc, count(*) AS n_items
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    "customer_revenue": """
        WITH s AS (SELECT o_custkey AS c_custkey, sum(l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(15,2))) AS revenue, count(DISTINCT l_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
        SELECT c_custkey, c_nationkey, revenue::DOUBLE AS revenue, n_orders, row_number() OVER (PARTITION BY c_nationkey ORDER BY revenue DESC, c_custkey) AS place FROM s JOIN customer USING (c_custkey)""",
}
