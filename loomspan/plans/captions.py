"""Queries on captions, keys, slugs and rendered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import text
from loomspan.operators import merging
from loomspan.plans.merging import _collapsed, _normalised
from loomspan.sources.tables import table

# no-break space, em space, ideographic space
_ODD = """CASE p_partkey % 7 WHEN 0 THEN '\u00a0Unknown\u2003' WHEN 1 THEN p_name || '\u00a0STRASSE ß\u3000。 '
    WHEN 2 THEN 'NA' WHEN 3 THEN '  ' || p_name || '\t!?' WHEN 4 THEN '语 ' || p_name WHEN 5 THEN NULL ELSE p_name || ' …' END"""


def caption_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions with odd white space, null words, a sharp s and ideographs: cleaned, normalised, judged."""
    odd = table(spark, sf_dir, "part").select("p_partkey", F.expr(_ODD).alias("c"))
    c = F.col("c")
    return odd.select("p_partkey", text.collapsed(c).alias("clean"), text.normalised(c).alias("normal"), text.is_latin_caption(c).alias("valid"))


_SAID = "CASE event_id % 4 WHEN 0 THEN upper(event_type) || '.' WHEN 1 THEN 'n/a' ELSE '  ' || event_type END"


def caption_agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user and hour, the one caption that all valid ones agree on."""
    said = table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).alias("hour"), "event_id", F.expr(_SAID).alias("caption"))
    groups = said.groupBy("user_id", "hour").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "caption"))), lambda x: x["caption"]).alias("c"))
    return groups.select("user_id", "hour", text.agreed_caption(F.col("c")).alias("caption"))


def caption_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid caption among language, part of the text and source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.first_caption(F.nullif("lang", F.lit("fr")), F.substring("text", 1, 7), F.col("source"))).alias("caption_md5"))


_KEY = "CASE l_orderkey % 6 WHEN 0 THEN l_linenumber || ' ' || l_partkey WHEN 1 THEN l_linenumber || ',' || l_partkey WHEN 2 THEN ' ' || l_linenumber || ' , -' || l_partkey WHEN 3 THEN l_linenumber || ' 2 3' WHEN 4 THEN l_linenumber || ' x' ELSE '' END"


def interval_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of written interval keys; null for others."""
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.interval_key(F.expr(_KEY)).alias("k"))
    return keys.select("l_orderkey", "l_linenumber", F.col("k.start").alias("first"), F.col("k.end").alias("last"))


_POINTER = "CASE p_partkey % 4 WHEN 0 THEN '/' WHEN 1 THEN p_name ELSE '/' || replace(p_name, ' ', '/') || '~1x~01' END"


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in JSON pointers."""
    parts = table(spark, sf_dir, "part").select("p_partkey", text.pointer_parts(F.expr(_POINTER)).alias("x"))
    return parts.select("p_partkey", F.size("x").cast("long").alias("n_names"), F.array_join("x", "|").alias("names"))


_FENCED = "CASE turn % 3 WHEN 0 THEN '```json' || chr(10) || text || chr(10) || '```  ' WHEN 1 THEN '  ' || text || chr(10) ELSE '```' || role || '```' END"


def unfenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of code fences."""
    said = table(spark, sf_dir, "conversations").where("text is not null and not text rlike '```'")
    return said.select("conv_id", "turn", F.md5(text.unfenced(F.expr(_FENCED))).alias("body_md5"))


def portable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug and portable id of every address."""
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", text.slug(F.col("url")).alias("slug"), text.portable_id(F.col("url")).alias("portable"))


def memory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight turns of every conversation as numbered lines, and the last two."""
    up, down = (Window.partitionBy("conv_id").orderBy(o) for o in (F.col("turn").asc(), F.col("turn").desc()))
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", "role", "turn").alias("line"), F.row_number().over(up).alias("u"), F.row_number().over(down).alias("d")).where("u <= 10 OR d <= 2")
    # at most twelve turns of a conversation come together
    of = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("turn", "line")))), lambda x: x["line"])
    turns = own.groupBy("conv_id").agg(of(F.col("u") <= 10).alias("first"), of(F.col("d") <= 2).alias("last"))
    return turns.select("conv_id", text.numbered(F.col("first"), 4).alias("shown"), F.array_join("last", "|").alias("short"))


_MAPS = (("/en", "/m1"), ("/en/a", "/m2"), ("/e", "/m3"), ("", "/rest"))


def path_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's path with its longest listed prefix replaced; prefixes end at a slash or the end."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/e"), F.col("page_id") % 3, F.regexp_replace("url", r"^https?:/", "")).alias("path"))
    pages = pages.select("page_id", F.regexp_replace("path", "^/e0", "/en").alias("path"))
    maps = spark.createDataFrame(list(_MAPS), "prefix string, target string")
    return merging.remap_longest(pages, "page_id", "path", maps)


QUERIES = {f.__name__: f for f in (caption_variants, caption_agreed, caption_first, interval_keys, pointers, unfenced, portable_ids, memory_lines, path_remap)}

_LATIN = lambda x: f"(regexp_matches({_collapsed(x)}, '[A-Za-z]') AND NOT regexp_matches({_collapsed(x)}, '[㐀-䶿一-鿿豈-﫿]'))"
_TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
ORACLES = {
    "caption_variants": f"""
        SELECT p_partkey, {_collapsed("c")} AS clean, {_normalised("c")} AS normal, {_LATIN("c")} AS valid FROM (SELECT p_partkey, {_ODD} AS c FROM part)""",
    "caption_agreed": f"""
        WITH s AS (SELECT user_id, date_trunc('hour', ts) AS hour, event_id, {_SAID} AS c FROM events)
        SELECT user_id, hour, CASE WHEN count(DISTINCT {_normalised("c")}) FILTER ({_LATIN("c")}) = 1 THEN arg_min({_collapsed("c")}, event_id) FILTER ({_LATIN("c")}) ELSE '' END AS caption FROM s GROUP BY 1, 2""",
    "caption_first": f"""
        WITH d AS (SELECT doc_id, nullif(lang, 'fr') AS a, substr(text, 1, 7) AS b, source AS c FROM documents)
        SELECT doc_id, md5(coalesce(CASE WHEN {_LATIN("a")} THEN {_collapsed("a")} END, CASE WHEN {_LATIN("b")} THEN {_collapsed("b")} END, CASE WHEN {_LATIN("c")} THEN {_collapsed("c")} END, '')) AS caption_md5 FROM d""",
    "interval_keys": rf"""
        WITH k AS (SELECT l_orderkey, l_linenumber, list_filter(string_split_regex(replace({_KEY}, ',', ' '), '\s+'), lambda x: x <> '') AS p FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN len(p) = 2 THEN CASE WHEN TRY_CAST(p[2] AS BIGINT) IS NOT NULL THEN TRY_CAST(p[1] AS BIGINT) END END AS first,
               CASE WHEN len(p) = 2 THEN TRY_CAST(p[2] AS BIGINT) END AS last FROM k""",
    "pointers": f"""
        WITH k AS (SELECT p_partkey, {_POINTER} AS p FROM part),
        n AS (SELECT p_partkey, CASE WHEN starts_with(p, '/') THEN list_transform(string_split(substr(p, 2), '/'), lambda x: replace(replace(x, '~1', '/'), '~0', '~')) END AS x FROM k)
        SELECT p_partkey, len(x) AS n_names, array_to_string(x, '|') AS names FROM n""",
    "unfenced": f"""
        WITH t AS (SELECT conv_id, turn, {_TRIM(_FENCED)} AS x FROM conversations WHERE text IS NOT NULL AND NOT contains(text, '```')), l AS (SELECT *, string_split(x, chr(10)) AS l FROM t)
        SELECT conv_id, turn, md5(CASE WHEN starts_with(x, '```') AND ends_with(x, '```') AND len(l) >= 3 THEN {_TRIM("array_to_string(l[2:len(l) - 1], chr(10))")} ELSE x END) AS body_md5 FROM l""",
    "portable_ids": r"""
        WITH s AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS slug FROM pages WHERE url IS NOT NULL)
        SELECT page_id, slug, regexp_replace(substr(slug, 1, 96), '[-.]+$', '') || '-' || substr(sha256(url), 1, 12) AS portable FROM s""",
    "memory_lines": """
        WITH t AS (SELECT conv_id, list(role || ' ' || turn ORDER BY turn) AS l FROM conversations GROUP BY 1), u AS (SELECT conv_id, l, l[1:10] AS c FROM t)
        SELECT conv_id, CASE WHEN len(c) > 4 THEN '[earlier steps omitted]' || chr(10) ELSE '' END
            || array_to_string(list_transform(list_zip(range(1, least(len(c), 4) + 1), c[greatest(len(c) - 3, 1):]), lambda x: x[1] || '. ' || x[2]), chr(10)) AS shown,
            array_to_string(l[greatest(len(l) - 1, 1):], '|') AS short FROM u""",
    "path_remap": rf"""
        WITH p AS (SELECT page_id, regexp_replace('/e' || page_id % 3 || regexp_replace(url, '^https?:/', ''), '^/e0', '/en') AS path FROM pages),
        m AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _MAPS)}) t(prefix, target))
        SELECT page_id, coalesce(arg_max(target || substr(path, length(prefix) + 1), length(prefix)) FILTER (prefix IS NOT NULL), any_value(path)) AS path
        FROM p LEFT JOIN m ON path = prefix OR starts_with(path, prefix || '/') GROUP BY page_id""",
}
