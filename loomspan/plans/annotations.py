"""Queries on annotations: every order has two flat levels and a nested one, written in all the ways that occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import annotations
from loomspan.plans.captions import _LATIN
from loomspan.sources.tables import table


def _flat(k: str, shift: int) -> str:
    """A level's text by k modulo 10: maps, lists, broken ones, none."""
    a, b, c = f"(o_orderkey % 3 + {shift})", "(o_custkey % 5 + 4)", "(o_custkey % 5 + 9)"
    said = "lower(o_orderpriority)"
    cases = (
        f"""'{{"' || {a} || ' ' || {b} || '":"' || {said} || '","' || {b} || ',' || {c} || '":"语 x","0 1":""}}'""",
        f"""'[{{"start_frame":' || {a} || ',"end_frame":' || {b} || ',"caption_en":"' || {said} || '","caption":"other"}}, {{"end_frame":' || {c} || ',"start_frame":' || {b} || ',"caption":"y"}}]'""",
        f"""'{{"' || {a} || ' ' || {b} || '":"x","oops":"y"}}'""",
        f"""'[{{"start_frame":true,"end_frame":2,"caption":"x"}},{{"start_frame":1,"end_frame":' || {b} || '}}]'""",
        "NULL", "'{}'", "'17'",
        f"""'[5,{{"start_frame":1,"end_frame":' || {b} || ',"caption":"z"}}]'""",
        f"""'{{"' || {b} || ' ' || {c} || '":5,"' || {a} || ' ' || {b} || '":"fine ' || {said} || '"}}'""",
        f"""'[{{"start_frame":' || {a} || ',"end_frame":' || {b} || ',"caption_en":null,"caption":"y"}},{{"start_frame":2.0,"end_frame":3}}]'""",
    )
    return f"CASE {k} % 10 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(cases)) + " END"


_HUMAN, _OTHER = _flat("o_orderkey", 0), _flat("(o_custkey + o_orderkey * 7)", 1)
_NESTED = """CASE o_orderkey % 4 WHEN 0 THEN
    '{"subtasks":[{"caption_en":"' || o_orderpriority || '","start_frame":0,"end_frame":' || o_custkey || ',"actions":[{"caption_en":"b","start_frame":0,"end_frame":4,"segment_details":[{"caption_en":"c","start_frame":0,"end_frame":2},{"caption_en":7}]},7]},' ||
    'null,{"caption_en":3,"start_frame":"1","actions":"none"},{"actions":[{"segment_details":[5,{"caption_en":"z","start_frame":1.5,"end_frame":true}]},{"caption_en":"q","end_frame":9}]}]}'
    WHEN 1 THEN '{"subtasks":[{"caption_en":"' || o_orderstatus || '"}]}' WHEN 2 THEN '{"subtasks":{"a":1}}' ELSE '[' || o_custkey || ']' END"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(_HUMAN).alias("human"), F.expr(_OTHER).alias("other"), F.expr(_NESTED).alias("nested"))


def flat_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every order's first level, which is a map or a list."""
    return annotations.level_units(_orders(spark, sf_dir), ["o_orderkey"], "human")


def flat_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels of every order over each other."""
    return annotations.overlay(_orders(spark, sf_dir), ["o_orderkey"], "human", "other")


def nested_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the nested annotation of every order, numbered by level."""
    return annotations.nested_units(_orders(spark, sf_dir), ["o_orderkey"], "nested")


_SHOWN = lambda items: F.array_join(F.transform(items, lambda e: F.concat_ws(":", e["start"], e["finish"], e["caption"])), ";")


def latin_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid entries of the levels that are maps."""
    return _orders(spark, sf_dir).select("o_orderkey", _SHOWN(annotations.latin_intervals(F.col("human"))).alias("items"))


_STRICT = """CASE o_orderkey % 6 WHEN 0 THEN '{"4 9":"b","0 ' || (o_custkey % 4 + 1) || '":"a","0 1":"语"}' WHEN 1 THEN '{"0 4":"a","7 ' || (o_custkey % 5 + 3) || '":"b"}' WHEN 2 THEN '{"0 4":" "}'
    WHEN 3 THEN '{"0 4":"a","4,9":"b"}' WHEN 4 THEN '[1]' ELSE '{" 2 ' || (o_custkey % 20 + 3) || '":"a"}' END"""


def strict_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of maps, or what is wrong with them."""
    own = _orders(spark, sf_dir).select("o_orderkey", annotations.strict_intervals(F.expr(_STRICT), F.when(F.col("o_custkey") % 2 == 0, 12), True).alias("s"))
    return own.select("o_orderkey", _SHOWN(F.col("s.items")).alias("items"), "s.error")


def joint_alignable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the entries of both levels of an order overlap each other throughout."""
    return _orders(spark, sf_dir).select("o_orderkey", annotations.alignable(annotations.entries(F.col("human"))["items"], annotations.entries(F.col("other"))["items"]).alias("fits"))


QUERIES = {f.__name__: f for f in (flat_levels, flat_overlay, nested_levels, latin_intervals, strict_intervals, joint_alignable)}

_WHOLE = lambda v, f: f"CASE WHEN json_type({v}, '$.{f}') IN ('UBIGINT', 'BIGINT') THEN ({v}->>'$.{f}')::BIGINT END"


def _entries(name: str, text: str) -> str:
    """{name}: (o_orderkey, pos, s, t, cap) of each entry, s null where it is broken; {name}_b: the orders whose level is broken."""
    return rf"""
    {name}_j AS (SELECT o_orderkey, {text} AS j, json_type({text}) AS kind FROM orders),
    {name} AS (
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY id) AS pos, CASE WHEN ok THEN p[1]::BIGINT END AS s, CASE WHEN ok THEN p[2]::BIGINT END AS t, cap FROM (
            SELECT o_orderkey, id, p, len(p) = 2 AND TRY_CAST(p[1] AS BIGINT) IS NOT NULL AND TRY_CAST(p[2] AS BIGINT) IS NOT NULL AS ok, cap
            FROM (SELECT o_orderkey, e.id, list_filter(string_split_regex(replace(e.key, ',', ' '), '\s+'), lambda x: x <> '') AS p, CASE WHEN e.type = 'VARCHAR' THEN e.value->>'$' ELSE '' END AS cap FROM {name}_j, json_each(j) e WHERE kind = 'OBJECT'))
        UNION ALL
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY id), CASE WHEN z IS NOT NULL THEN a END, CASE WHEN a IS NOT NULL THEN z END, cap FROM (
            SELECT o_orderkey, e.id, CASE WHEN e.type = 'OBJECT' THEN {_WHOLE("e.value", "start_frame")} END AS a, CASE WHEN e.type = 'OBJECT' THEN {_WHOLE("e.value", "end_frame")} END AS z,
                CASE WHEN e.type <> 'OBJECT' THEN '' WHEN json_exists(e.value, '$.caption_en') THEN CASE WHEN json_type(e.value, '$.caption_en') = 'VARCHAR' THEN e.value->>'$.caption_en' ELSE '' END WHEN json_type(e.value, '$.caption') = 'VARCHAR' THEN e.value->>'$.caption' ELSE '' END AS cap
            FROM {name}_j, json_each(j) e WHERE kind = 'ARRAY')),
    {name}_b AS (SELECT o_orderkey FROM {name}_j WHERE kind NOT IN ('OBJECT', 'ARRAY', 'NULL') UNION SELECT o_orderkey FROM {name} WHERE s IS NULL)"""


def _maps(text: str) -> str:
    return rf"""
    SELECT o_orderkey, e.id, TRY_CAST(regexp_extract(e.key, '^\s*(\d+)\s+(\d+)\s*$', 1) AS BIGINT) AS s, TRY_CAST(regexp_extract(e.key, '^\s*(\d+)\s+(\d+)\s*$', 2) AS BIGINT) AS t,
        trim(CASE WHEN e.type = 'VARCHAR' THEN e.value->>'$' ELSE '' END) AS cap FROM (SELECT o_orderkey, {text} AS j FROM orders) q, json_each(j) e WHERE json_type(j) = 'OBJECT'"""


def _nest(parent: str, field: str) -> str:
    return f"""
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY path) - 1 AS unit, path, value FROM (
        SELECT p.o_orderkey, list_append(p.path, e.id) AS path, e.value FROM (SELECT * FROM {parent} WHERE json_type(value, '$.{field}') = 'ARRAY') p, json_each(p.value->'{field}') e WHERE e.type = 'OBJECT')"""


_UNIT = lambda level, t: f"SELECT o_orderkey, {level} AS level, unit::INT AS unit, CASE WHEN json_type(value, '$.caption_en') = 'VARCHAR' THEN value->>'$.caption_en' ELSE '' END AS caption, {_WHOLE('value', 'start_frame')} AS start, {_WHOLE('value', 'end_frame')} AS finish FROM {t}"
ORACLES = {
    "flat_levels": f"""
        WITH {_entries("h", _HUMAN)} SELECT o_orderkey, (pos - 1)::INT AS unit, cap AS caption, s AS start, t AS finish FROM h WHERE o_orderkey NOT IN (SELECT o_orderkey FROM h_b)""",
    "flat_overlay": f"""
        WITH {_entries("h", _HUMAN)}, {_entries("g", _OTHER)}, a AS (SELECT * FROM h WHERE o_orderkey NOT IN (SELECT o_orderkey FROM h_b)),
        b AS (SELECT * FROM g WHERE s IS NOT NULL AND (o_orderkey NOT IN (SELECT o_orderkey FROM g_b) OR o_orderkey IN (SELECT o_orderkey FROM a))),
        u AS (SELECT o_orderkey, s, t, x.cap AS hc, y.cap AS oc FROM (SELECT o_orderkey, s, t, arg_max(cap, pos) AS cap FROM a GROUP BY ALL) x FULL JOIN (SELECT o_orderkey, s, t, arg_max(cap, pos) AS cap FROM b GROUP BY ALL) y USING (o_orderkey, s, t)),
        v AS (SELECT *, hc IS NOT NULL AND {_LATIN("hc")} AS hv, oc IS NOT NULL AND {_LATIN("oc")} AS ov FROM u)
        SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY s, t) - 1)::INT AS unit, CASE WHEN hv THEN hc WHEN ov THEN oc ELSE '' END AS caption, s AS start, t AS finish, CASE WHEN hv THEN 'human_segment' ELSE 'segment' END AS source FROM v""",
    "nested_levels": f"""
        WITH l2 AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY e.id) - 1 AS unit, [e.id] AS path, e.value, e.type FROM (SELECT o_orderkey, {_NESTED} AS j FROM orders) q, json_each(j->'subtasks') e WHERE json_type(j, '$.subtasks') = 'ARRAY'),
        k2 AS (SELECT * FROM l2 WHERE type = 'OBJECT'), l1 AS ({_nest("k2", "actions")}), l0 AS ({_nest("l1", "segment_details")})
        {_UNIT(2, "k2")} UNION ALL {_UNIT(1, "l1")} UNION ALL {_UNIT(0, "l0")}""",
    "latin_intervals": f"""
        WITH m AS ({_maps(_HUMAN)}) SELECT o_orderkey, coalesce(string_agg(s || ':' || t || ':' || cap, ';' ORDER BY s, t, cap) FILTER (t > s AND {_LATIN("cap")}), '') AS items FROM orders LEFT JOIN m USING (o_orderkey) GROUP BY 1""",
    "strict_intervals": f"""
        WITH m AS ({_maps(_STRICT)}),
        w AS (SELECT *, CASE WHEN s IS NULL OR t IS NULL OR cap = '' THEN 'invalid_entry' WHEN s >= t THEN 'invalid_interval' WHEN o_custkey % 2 = 0 AND t > 12 THEN 'beyond_total' END AS e FROM m JOIN orders USING (o_orderkey)),
        r AS (SELECT o_orderkey, CASE WHEN count(m.o_orderkey) = 0 THEN 'missing' ELSE any_value(f.e) END AS error, string_agg(m.s || ':' || m.t || ':' || m.cap, ';' ORDER BY m.s, m.t, m.cap) AS items
            FROM orders LEFT JOIN m USING (o_orderkey) LEFT JOIN (SELECT o_orderkey, arg_min(e, id) FILTER (e IS NOT NULL) AS e FROM w GROUP BY 1) f USING (o_orderkey) GROUP BY 1)
        SELECT o_orderkey, CASE WHEN error IS NULL THEN items END AS items, error FROM r""",
    "joint_alignable": f"""
        WITH {_entries("h", _HUMAN)}, {_entries("g", _OTHER)}, a AS (SELECT o_orderkey, s, t FROM h WHERE s IS NOT NULL), b AS (SELECT o_orderkey, s, t FROM g WHERE s IS NOT NULL)
        SELECT o_orderkey, EXISTS (SELECT 1 FROM a WHERE a.o_orderkey = o.o_orderkey) AND EXISTS (SELECT 1 FROM b WHERE b.o_orderkey = o.o_orderkey)
            AND NOT EXISTS (SELECT 1 FROM a WHERE a.o_orderkey = o.o_orderkey AND NOT EXISTS (SELECT 1 FROM b WHERE b.o_orderkey = a.o_orderkey AND least(a.t, b.t) > greatest(a.s, b.s)))
            AND NOT EXISTS (SELECT 1 FROM b WHERE b.o_orderkey = o.o_orderkey AND NOT EXISTS (SELECT 1 FROM a WHERE a.o_orderkey = b.o_orderkey AND least(a.t, b.t) > greatest(a.s, b.s))) AS fits FROM orders o""",
}
