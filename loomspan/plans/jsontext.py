"""Queries on JSON that was written badly: plans are put together from the parts' names and damaged in known ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import jsontext
from loomspan.sources.tables import table


def _segment(k: int, caption: str) -> str:
    return f"""'{{"index":{k},"segment":{{"caption":"' || {caption} || '"}}}}'"""


def _item(k: int, caption: str, *segments: str) -> str:
    return f"""'{{"index":{k},"action":{{"caption":"' || {caption} || '","segments":[' || {" || ',' || ".join(_segment(i + 1, s) for i, s in enumerate(segments))} || ']}}}}'"""


_OPEN = """'{"initial_plan":['"""
#: a name with an escaped quote, a bracket and a letter outside ASCII
_ODD = "p_name || ' ü' || chr(92) || chr(34) || '{'"
_FIRST = _item(1, _ODD, "p_type", "p_brand")
_SECOND = _item(2, "p_brand", "p_name")
_WHOLE = f"{_OPEN} || {_FIRST} || ',' || {_SECOND} || ']}}'"
_CUT = lambda text, n: f"substr({text}, 1, length({text}) - {n})"
_CLOSED = f"""replace({_WHOLE}, p_brand || '","segments"', p_brand || '"}} "segments"')"""
_UNQUOTED = f"""replace({_WHOLE}, p_brand || '","segments"', p_brand || '"}}segments"')"""
_FENCE = "chr(96) || chr(96) || chr(96)"
_ONE = f"{_OPEN} || {_FIRST}"


def _by(key: str, *cases: str) -> str:
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END"


_DAMAGED = _by(
    "p_partkey", _WHOLE, _CUT(_WHOLE, 2), _CLOSED, _UNQUOTED, f"""{_ONE} || ',{{"index":2,"action":{{"caption":"' || p_name""", f"{_ONE} || '}}'", f"{_ONE} || ',  '",
    f"{_FENCE} || 'json' || chr(10) || {_CUT(_WHOLE, 2)} || chr(10) || {_FENCE}", _CUT(_CLOSED, 4), """'{"initial_plan":[{"index":1,"action":{"caption":"' || p_name""",
)
_MENDED = _by("p_partkey", "NULL", _WHOLE, _WHOLE, _WHOLE, f"{_ONE} || ']}}'", "NULL", f"{_ONE} || ']}}'", _WHOLE, _WHOLE, "NULL")
_EARLY, _LOST, _DROP, _COMMA, _APPEND = "remove_premature_action_close_before_segments", "restore_segments_open_quote_and_separator", "drop_incomplete_trailing_initial_plan_item", "strip_trailing_separator_comma", "append_missing_eof_closers"
_DONE = _by(
    "p_partkey", "NULL", f"'{_APPEND}:]}}'", f"'{_EARLY}:1'", f"'{_LOST}:1'", f"'{_DROP}:' || length({_ONE})", "NULL", f"'{_COMMA};{_APPEND}:]}}'", f"'{_APPEND}:]}}'", f"'{_EARLY}:1;{_APPEND}:}}}}]}}'", "NULL",
)


def json_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged plans mended, and what was done to each."""
    own = table(spark, sf_dir, "part").select("p_partkey", jsontext.repaired(F.expr(_DAMAGED)).alias("r"))
    done = F.array_join(F.transform("r.operations", lambda o: F.concat_ws(":", o["operation"], o["count"], o["cut"], o["suffix"])), ";")
    return own.select("p_partkey", F.md5("r.repaired").alias("repaired_md5"), done.alias("done"))


_THREE = _item(1, "p_name", "p_type", "p_brand", "p_name")
_AFTER_TWO = lambda k: f"""'{{"index":{k},"action":{{"caption":"' || p_name || '","segments":[' || {_segment(1, "p_type")} || ',' || {_segment(2, "p_brand")}"""
_LONG = _by(
    "p_partkey", f"'note ' || {_WHOLE}", f"{_OPEN} || {_FIRST} || ',' || {_SECOND} || ',' || {_item(3, 'p_name', 'p_type')} || ']}}'", f"'note ' || {_OPEN} || {_THREE} || ']}}'",
    f"{_ONE} || '}},{{{{'", "p_name", f"{_OPEN} || {_FIRST} || ', ' || {_AFTER_TWO(2)} || ',{{'",
)
_REASON = _by("p_partkey", "NULL", "'maximum_actions'", "'maximum_segments_per_action'", "NULL", "NULL", "'maximum_segments_per_action'")
_PLACE = _by("p_partkey", "NULL", f"length({_OPEN} || {_FIRST} || ',' || {_SECOND})", f"length('note ' || {_OPEN} || {_AFTER_TWO(1)})", "NULL", "NULL", f"length({_OPEN} || {_FIRST} || ', ' || {_AFTER_TWO(2)})")


def json_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where plans go beyond two actions or two segments of one."""
    return table(spark, sf_dir, "part").select("p_partkey", jsontext.stop_place(F.expr(_LONG), 2, 2).alias("s")).select("p_partkey", "s.*")


_OUTPUT = _by(
    "p_partkey", _WHOLE, f"'  ' || {_WHOLE} || '  end'", f"{_WHOLE} || ' and trial_id ' || p_partkey", f"""{_WHOLE} || '{{"a":1,"b":2}}'""", f"{_WHOLE} || ' ' || p_name || ' and more'", "'  '", "p_name || '{'", "NULL", "'12 [3, 4, 5, 6]'", _CUT(_WHOLE, 1),
)
_CLASS = _by("p_partkey", "'clean_json'", "'tiny_trailing_suffix'", "'trailing_trial_id'", "'repeated_json'", "'other_trailing_text'", "'empty'", "'no_json_prefix'", "'empty'", "'repeated_json'", "'no_json_prefix'")


def json_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each output is."""
    return table(spark, sf_dir, "part").select("p_partkey", jsontext.output_class(F.expr(_OUTPUT)).alias("class"))


def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first caption of outputs that are one JSON object, and the number of their names."""
    own = table(spark, sf_dir, "part").select("p_partkey", jsontext.json_object(F.expr(_by("p_partkey", _WHOLE, _CUT(_WHOLE, 2), f"{_FENCE} || 'json' || chr(10) || {_WHOLE} || chr(10) || {_FENCE}", "'[1]'", "NULL", "p_name"))).alias("v"))
    return own.select("p_partkey", F.col("v").isNotNull().alias("found"), F.try_variant_get("v", "$.initial_plan[0].action.caption", "string").alias("caption"))


_EXTRA = f"""replace({_WHOLE}, '"index":2,"action"', '"index":2,"note":true,"action"')"""
_FIELDS = _by(
    "p_partkey", _WHOLE, _EXTRA, f"""{_CUT(_WHOLE, 2)} || ',{{"index":9,"action":{{"caption":" "}}}}]}}'""", f"""{_OPEN} || '{{"index":7,"action":{{"caption":"' || p_brand || '"}},"segment":{{"caption":"' || p_type || '","x":1}}}}]}}'""",
    f"""replace({_WHOLE}, '"segments":[' || {_segment(1, "p_name")}, '"segments":[5,{{"index":1}},' || {_segment(1, "p_name")})""", "'{\"plan\":[]}'",
)
_CANONICAL = _by("p_partkey", "NULL", _WHOLE, _WHOLE, f"{_OPEN} || {_item(1, 'p_brand', 'p_type')} || ']}}'", _WHOLE, "NULL")
_COUNTS = [_by("p_partkey", "NULL", *map(str, c), "NULL") for c in ((0, 1, 0, 0), (0, 0, 0, 2), (0, 0, 1, 0), (1, 0, 1, 0))]
_COUNTED = ("dropped_items", "dropped_segments", "projected_segments", "removed_keys")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans with their own fields alone, and what was left out."""
    own = table(spark, sf_dir, "part").select("p_partkey", jsontext.canonical(F.expr(_FIELDS), True).alias("c"))
    return own.select("p_partkey", F.md5("c.plan").alias("plan_md5"), *(f"c.{c}" for c in _COUNTED))


def compact_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as plans without repeated actions and segments, with at most three actions and one segment."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_name", "p_type")
    lines = table(spark, sf_dir, "lineitem").join(parts, "l_partkey").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", f"{_LINE} AS caption", f"{_INNER} AS segments")
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    plans = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "caption", "segments"))), lambda x: F.struct(x["caption"].alias("caption"), x["segments"].alias("segments"))).alias("plan"))
    own = plans.select("l_orderkey", jsontext.compacted(F.col("plan"), 3, 1).alias("c"))
    shown = F.array_join(F.transform("c.kept", lambda a: F.concat(a["caption"], F.coalesce(F.concat(F.lit("["), F.array_join(a["segments"], ","), F.lit("]")), F.lit("")))), ";")
    return own.select("l_orderkey", shown.alias("kept"), *(f"c.{c}" for c in ("repeated_actions", "repeated_segments", "above_actions", "above_segments", "n_alone", "n_joint")))


_LINE = "CASE WHEN l_suppkey % 2 = 0 THEN upper(p_type) || '  x' ELSE lower(p_type) || ' x ' END"
_INNER = "CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 3 = 1 THEN array(p_name, upper(p_name), p_type) ELSE array(p_name) END"

_POINTED = """'{"id": ' || p_partkey || ', "a/b": {"name": "' || p_name || ' ü", "list": [1, 2.5, "' || p_brand || '"]}, "k": null}'"""
_POINTERS = (("/a~1b/name", "/id"), ("/a~1b/list/2",), ("/k", "/a~1b/list"), ("/a~1b", "/a~1b/name"), ("/id", "/id"), ("/a~1b/list/3",), ("id",), ())


def mask_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of compact JSON between markers, and the errors of pointers that name none."""
    pointers = F.expr(_by("p_partkey", *(f"array({', '.join(repr(p) for p in names)})" if names else "CAST(array() AS array<string>)" for names in _POINTERS)))
    own = table(spark, sf_dir, "part").select("p_partkey", jsontext.value_spans(F.expr(_POINTED), pointers).alias("s")).select("p_partkey", "s.*")
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["pointer"], s["begin"], s["finish"])), " ")
    return own.select("p_partkey", "text", places.alias("places"), jsontext.marked(F.col("text"), F.col("spans")).alias("marked"), "error")


QUERIES = {f.__name__: f for f in (json_repairs, json_stops, json_classes, json_objects, json_fields, compact_plans, mask_spans)}

_TEXT = """'{"id":' || p_partkey || ',"a/b":{"name":"' || p_name || ' ü","list":[1,2.5,"' || p_brand || '"]},"k":null}'"""
_MARK = lambda k, x: f"'<|V5MASK_0{k}_START|>' || {x} || '<|V5MASK_0{k}_END|>'"
_MARKED = _by(
    "p_partkey",
    f"""'{{"id":' || {_MARK(0, "p_partkey")} || ',"a/b":{{"name":' || {_MARK(1, "'\"' || p_name || ' ü\"'")} || ',"list":[1,2.5,"' || p_brand || '"]}},"k":null}}'""",
    f"""'{{"id":' || p_partkey || ',"a/b":{{"name":"' || p_name || ' ü","list":[1,2.5,' || {_MARK(0, "'\"' || p_brand || '\"'")} || ']}},"k":null}}'""",
    f"""'{{"id":' || p_partkey || ',"a/b":{{"name":"' || p_name || ' ü","list":' || {_MARK(0, "'[1,2.5,\"' || p_brand || '\"]'")} || '}},"k":' || {_MARK(1, "'null'")} || '}}'""",
    "NULL", "NULL", "NULL", "NULL", _TEXT,
)
_AT = lambda before, value, name: f"'{name}:' || length({before}) || ':' || (length({before}) + length({value}))"
_BEFORE_NAME = """('{"id":' || p_partkey || ',"a/b":{"name":')"""
_BEFORE_LIST = f"""({_BEFORE_NAME} || '"' || p_name || ' ü","list":')"""
_LIST = """('[1,2.5,"' || p_brand || '"]')"""
_PLACES = _by(
    "p_partkey", _AT("""'{"id":'""", "p_partkey::VARCHAR", "/id") + " || ' ' || " + _AT(_BEFORE_NAME, "('\"' || p_name || ' ü\"')", "/a~1b/name"), _AT(f"({_BEFORE_LIST} || '[1,2.5,')", "('\"' || p_brand || '\"')", "/a~1b/list/2"),
    _AT(_BEFORE_LIST, _LIST, "/a~1b/list") + " || ' ' || " + _AT(f"""({_BEFORE_LIST} || {_LIST} || '}},"k":')""", "'null'", "/k"), "NULL", "NULL", "NULL", "NULL", "''",
)
ORACLES = {
    "json_repairs": f"SELECT p_partkey, md5({_MENDED}) AS repaired_md5, {_DONE} AS done FROM part",
    "json_stops": f"""SELECT p_partkey, {_REASON} AS reason, ({_PLACE})::INT AS cut, {_by("p_partkey", "NULL", "2", "0", "NULL", "NULL", "1")} AS n_actions, {_by("p_partkey", "NULL", "0", "2", "NULL", "NULL", "2")} AS n_segments FROM part""",
    "json_classes": f"SELECT p_partkey, {_CLASS} AS class FROM part",
    "json_objects": "SELECT p_partkey, p_partkey % 6 IN (0, 2) AS found, CASE WHEN p_partkey % 6 IN (0, 2) THEN p_name || ' ü\"{' END AS caption FROM part",
    "json_fields": f"""SELECT p_partkey, md5({_CANONICAL}) AS plan_md5, {", ".join(f"{c} AS {n}" for c, n in zip(_COUNTS, _COUNTED, strict=True))} FROM part""",
    "compact_plans": f"""
        WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, {_LINE} AS cap, {_INNER.replace("array(", "list_value(")} AS seg FROM lineitem JOIN part ON p_partkey = l_partkey),
        k AS (SELECT *, trim(regexp_replace(lower(cap), '\\s+', ' ', 'g')) AS key FROM l), f AS (SELECT *, min(i) OVER (PARTITION BY l_orderkey, key) AS first FROM k),
        r AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY first) AS nth FROM f), t AS (SELECT *, nth <= 3 AND i = first AS taken FROM r),
        s AS (SELECT l_orderkey, i, unnest(seg) AS s, generate_subscripts(seg, 1) AS p FROM t WHERE taken AND seg IS NOT NULL),
        sf AS (SELECT *, min(p) OVER (PARTITION BY l_orderkey, i, lower(s)) AS first FROM s), sr AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey, i ORDER BY first) AS nth FROM sf),
        sk AS (SELECT l_orderkey, i, string_agg(s, ',' ORDER BY p) FILTER (nth <= 1 AND p = first) AS kept, count(*) FILTER (nth <= 1 AND p <> first) AS rep, count(*) FILTER (nth > 1) AS abo FROM sr GROUP BY ALL)
        SELECT l_orderkey, string_agg(cap || coalesce('[' || kept || ']', ''), ';' ORDER BY i) FILTER (taken) AS kept, (count(*) FILTER (nth <= 3 AND i <> first))::INT AS repeated_actions, coalesce(sum(rep), 0)::INT AS repeated_segments,
            (count(*) FILTER (nth > 3))::INT AS above_actions, coalesce(sum(abo), 0)::INT AS above_segments, (count(*) FILTER (seg IS NULL))::INT AS n_alone, (count(*) FILTER (seg IS NOT NULL))::INT AS n_joint FROM t LEFT JOIN sk USING (l_orderkey, i) GROUP BY l_orderkey""",
    "mask_spans": f"""
        SELECT p_partkey, CASE WHEN p_partkey % 8 IN (0, 1, 2, 7) THEN {_TEXT} END AS text, {_PLACES} AS places, {_MARKED} AS marked,
            CASE p_partkey % 8 WHEN 3 THEN 'pointer_inside_another' WHEN 4 THEN 'repeated_pointer' WHEN 5 THEN 'missing_pointer' WHEN 6 THEN 'invalid_pointer' END AS error FROM part""",
}
