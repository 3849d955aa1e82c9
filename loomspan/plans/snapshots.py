"""Queries on digests of tables, snapshots of several sources, video boxes, and bins dealt to workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import digests, ranks
from loomspan.sources import boxes
from loomspan.sources.jsonl import shared_path
from loomspan.sources.tables import table


def _box(kind: str, *content: str, size: str | None = None) -> str:
    """A box as an SQL text of hex digits."""
    inner = " || ".join(content) or "''"
    return f"({size or f'''lpad(hex(CAST(length({inner}) / 2 + 8 AS BIGINT)), 8, '0')'''} || '{kind.encode().hex()}' || {inner})"


_number = lambda n: f"lpad(hex(CAST({n} AS BIGINT)), 8, '0')"
_HANDLER = lambda kind: _box("hdlr", f"'{'00' * 8}{kind.encode().hex()}{'00' * 12}'")
_track = lambda kind, *tables: _box("trak", _box("tkhd", "'0000'"), _box("mdia", _HANDLER(kind), _box("minf", _box("stbl", *tables))))
_sizes = lambda kind, n: _box(kind, f"'{'00' * 8}'", _number(n), "'ABCD'")
_times = lambda runs, *counts: _box("stts", "'00000000'", _number(runs), *(f"{_number(c)} || '00000001'" for c in counts))
_FILE = _box("ftyp", "'69736F6D'")
_VIDEOS = (
    (_FILE + " || " + _box("moov", _track("vide", _sizes("stsz", "p_size"))), "p_size", None),
    (_box("moov", _track("soun", _sizes("stsz", "7")), _track("vide", _sizes("stz2", "p_partkey + 1"))), "p_partkey + 1", None),
    (_box("moov", _track("vide", _sizes("stsz", "0"), _times(2, "p_size", "5"))), "p_size + 5", None),
    (_FILE, None, "no_movie"),
    (_box("moov", _track("soun", _sizes("stsz", "7"))), None, "no_video_track"),
    (_box("mdat", "'0000000000000014'", "'01020304'", size="'00000001'") + " || " + _box("moov", _track("vide", _sizes("stsz", "p_size * 3"))), "p_size * 3", None),
    (_FILE + " || '000000FF6D6F6F76'", None, "invalid_box"),
    ("'000000'", None, "no_container"),
    (_FILE + " || " + _box("moov", _track("vide", _sizes("stsz", "p_size + 1")), size="'00000000'"), "p_size + 1", None),
    (_box("moov", _box("trak", _box("mdia", _HANDLER("vide"), _box("minf")))), None, "no_sample_table"),
    (_box("moov", _track("vide", _times(9, "p_size"))), None, "cut_time_table"),
    (_box("moov", _track("vide", _times(0))), None, "no_count"),
)
_CASES = lambda texts: f"CASE p_partkey % {len(_VIDEOS)} " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts)) + " END"


def box_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of containers made of the parts' sizes, or why they have none."""
    own = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.expr(_CASES(v[0] for v in _VIDEOS))).alias("content"))
    return own.select("p_partkey", boxes.frame_counts(F.col("content")).alias("c")).select("p_partkey", "c.*")


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def leaf_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and digest of the lines of each flag and status."""
    own = table(spark, sf_dir, "lineitem").withColumn("l_suppkey", F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey")))
    return digests.table_digest(own, _KEYS, ["l_returnflag", "l_linestatus"])


_SETTINGS = {"stride": "10", "seed": "827"}


def composed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of three sources of orders, in leaves by priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return digests.compose({f"source_{s.lower()}": orders.where(F.col("o_orderstatus") == s) for s in "PFO"}, ["o_orderpriority"], ["o_orderkey", "o_custkey"], _SETTINGS)


def same_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether orders are the same in two catalogs, one of which lacks some and has others changed."""
    left = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    right = left.where("o_orderkey % 5 <> 0").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey", "CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus", "o_orderpriority")
    return digests.same_but(left, right, ["o_orderkey"], ["o_orderstatus"])


_BUCKET = "CASE WHEN event_id % 10 = 0 THEN 'initial' WHEN event_id % 2 = 0 AND event_type IN ('view', 'click') THEN 'end' WHEN event_id % 2 = 1 THEN 'ongoing' ELSE 'other' END"
_SAID = "CASE WHEN event_id % 10 = 0 AND event_type <> 'error' THEN 'view' WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'view' ELSE 'click' END ELSE event_type END"
_REQUIRED = {"initial": ["view"], "end": ["view", "click"], "ongoing": ["view", "click", "retry"], "absent": ["view"]}


def context_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which contexts the buckets of events lack or may not have."""
    own = table(spark, sf_dir, "events").select(F.expr(_BUCKET).alias("bucket"), F.expr(_SAID).alias("context"))
    return digests.required_contexts(own, "bucket", "context", _REQUIRED, ["initial"], ("view", "click"))


def dealt_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as bins for seven workers in the third epoch."""
    return ranks.dealt_bins(table(spark, sf_dir, "customer"), "c_custkey", 7, 42, 3)


def few_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as bins for 64 workers: all come more than once."""
    return ranks.dealt_bins(table(spark, sf_dir, "nation"), "n_nationkey", 64, 42)


def cached_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated lengths of the conversations' turns, kept by their settings and read back: one part can't be told."""
    turns = table(spark, sf_dir, "conversations").withColumn("item", F.concat_ws(":", "conv_id", "turn"))
    length = F.when(F.col("role") != "system", F.ceil(F.length("text") / 3) + 400 * (F.col("turn") % 3) + 256).otherwise(F.when(F.col("turn") > 0, -5))
    length = F.when(F.col("conv_id") % 17 != 0, length)
    folder, config = shared_path(spark), {"per_image": 400, "characters": 3}
    ranks.cached_lengths(turns, "item", length, config, folder)
    return ranks.length_report(ranks.cached_lengths(turns, "item", F.lit(None), dict(reversed(config.items())), folder))


def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths of the words of a conversation's turns end to end, filled up to 64."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.transform(F.split("text", " "), F.length)).alias("tokens"))
    own = ranks.packed_rows(turns, "conv_id", ["turn"], "tokens", 64, 0)
    return own.select("bin", F.md5(F.array_join("tokens", ",")).alias("tokens_md5"), F.array_join("ends", ",").alias("ends"), "real")


QUERIES = {f.__name__: f for f in (box_frames, leaf_digests, composed_snapshot, same_accepted, context_contract, dealt_bins, few_bins, cached_lengths, packed_rows)}


def _digest(columns: list[str], group: str, source: str, more: str = "") -> str:
    parts = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in columns)
    return f"""SELECT {group}count(*) AS n, sha256(concat_ws('|', count(*), coalesce(bit_xor(a), 0), coalesce(sum(a), 0), coalesce(bit_xor(b), 0), coalesce(sum(b), 0))) AS digest{more}
        FROM (SELECT *, ('0x' || substr(h, 1, 15))::BIGINT AS a, ('0x' || substr(h, 16, 15))::BIGINT AS b FROM (SELECT *, sha256({parts}) AS h FROM {source})) {f"GROUP BY {group.rstrip(', ')}" if group else ""}"""


_DEAL = lambda source, key, workers, start: f"""
        WITH b AS (SELECT {key} AS bin, row_number() OVER (ORDER BY sha256('{start}' || {key}), {key}) - 1 AS p, count(*) OVER () AS n FROM {source}),
        t AS (SELECT *, unnest(range(((n + {workers - 1}) // {workers} * {workers} - 1 - p) // n + 1)) AS turn FROM b)
        SELECT bin, (p + turn * n) // {workers} AS step, (p + turn * n) % {workers} AS rank, turn > 0 AS again FROM t"""  # noqa: E731
ORACLES = {
    "box_frames": f"SELECT p_partkey, ({_CASES((v[1] or 'NULL') for v in _VIDEOS)})::BIGINT AS frames, {_CASES((repr(v[2]) if v[2] else 'NULL') for v in _VIDEOS)} AS reason FROM part",
    "leaf_digests": _digest(_KEYS, "l_returnflag, l_linestatus, ", "(SELECT * REPLACE (CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey END AS l_suppkey) FROM lineitem)"),
    "composed_snapshot": f"""
        WITH l AS ({_digest(["o_orderkey", "o_custkey"], "source, o_orderpriority, ", "(SELECT *, 'source_' || lower(o_orderstatus) AS source FROM orders)")}),
        w AS ({_digest(["source", "o_orderpriority", "n", "digest"], "", "l", ", sum(n)::BIGINT AS rows, count(DISTINCT source) AS n_sources")})
        SELECT rows AS n, n AS leaves, n_sources, digest AS content_digest, sha256(digest || '|seed=827;stride=10|source_f,source_o,source_p') AS input_key FROM w""",
    "same_accepted": "SELECT o_orderkey, o_orderkey % 7 <> 0 AS same FROM orders WHERE o_orderkey % 5 <> 0",
    "context_contract": f"""
        WITH e AS (SELECT {_BUCKET} AS bucket, {_SAID} AS c FROM events), w AS (SELECT * FROM (VALUES ('initial', ['view'], true), ('end', ['click', 'view'], false), ('ongoing', ['click', 'retry', 'view'], false), ('absent', ['view'], false)) v(bucket, wanted, exact)),
        s AS (SELECT bucket, count(*) AS n, list_sort(list(DISTINCT c)) AS seen, count(*) FILTER (c = 'view') = count(*) FILTER (c = 'click') AS alike FROM e GROUP BY 1),
        j AS (SELECT bucket, coalesce(n, 0) AS n, list_filter(wanted, lambda x: NOT list_contains(coalesce(seen, []), x)) AS missing, CASE WHEN exact THEN list_filter(coalesce(seen, []), lambda x: NOT list_contains(wanted, x)) ELSE [] END AS extra, exact OR coalesce(alike, true) AS alike FROM w LEFT JOIN s USING (bucket))
        SELECT bucket, n, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra, len(missing) = 0 AND len(extra) = 0 AND alike AS passed FROM j""",
    "dealt_bins": _DEAL("customer", "c_custkey", 7, "42:3:"),
    "few_bins": _DEAL("nation", "n_nationkey", 64, "42:0:"),
    "cached_lengths": """
        WITH l AS (SELECT CASE WHEN conv_id % 17 <> 0 THEN CASE WHEN role <> 'system' THEN (length(text) + 2) // 3 + 400 * (turn % 3) + 256 WHEN turn > 0 THEN -5 END END AS n FROM conversations)
        SELECT count(*) AS n, count(*) FILTER (n IS NULL OR n < 0) AS failed, sum(n) FILTER (n >= 0)::BIGINT AS total FROM l""",
    "packed_rows": """
        WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN list_transform(string_split(text, ' '), lambda x: length(x)) ELSE [] END AS t FROM conversations),
        n AS (SELECT *, sum(len(t)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM t),
        b AS (SELECT conv_id AS bin, flatten(list(t ORDER BY turn)) AS f, '0,' || string_agg(e::BIGINT, ',' ORDER BY turn) AS ends FROM n GROUP BY 1)
        SELECT bin, md5(array_to_string(list_concat(f, list_transform(range(greatest(64 - len(f), 0)), lambda x: 0)), ',')) AS tokens_md5, ends, len(f)::INT AS real FROM b""",
}
