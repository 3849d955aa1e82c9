"""Queries on deduplication, unions, fences, upserts and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import text
from loomspan.operators import merging
from loomspan.sources.tables import table


def _identity():
    return F.sha2(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", " "))), 256)


def dedup_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each normalised text: the first by source, then id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", _identity().alias("identity"))
    return merging.first_of(docs, ["identity"], [F.col("source"), F.col("doc_id")], ["doc_id", "source"])


_RENAMED = "CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE source END"


def strict_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of short and long documents that share a middle: copies of each id, and whether they conflict, as those of one source in three do."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    parts = [docs.where("n_chars < 2000"), docs.where("n_chars >= 1000").withColumn("source", F.expr(_RENAMED))]
    return merging.checked_union(parts, "doc_id", F.concat_ws(":", "source", F.least("n_chars", F.lit(1500))))


#: as many items as any benchmark table has
_ITEMS = 40
_PUT = "CASE WHEN b IS NULL THEN text WHEN doc_id % 9 = 0 THEN upper(b) || ' .' WHEN doc_id % 9 = 1 THEN replace(b, chr(10), ' ') || chr(10) || text WHEN doc_id % 9 = 2 THEN text || chr(10) || replace(b, chr(10), ' ') ELSE text END"


def holdout_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose whole text, first paragraph or last paragraph is a benchmark item; items are put into three of nine documents."""
    held = table(spark, sf_dir, "benchmark").select("text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.col("text").alias("b"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(items, F.expr(f"doc_id % {_ITEMS} = i"), "left").select("doc_id", F.expr(_PUT).alias("text"))
    whole = F.sha2(text.normalised(F.col("text")), 256)
    lines = F.split("text", "\n")
    modes = {
        "whole": (whole, whole),
        "first": (F.sha2(text.normalised(F.element_at(lines, 1)), 256), whole),
        "last": (F.sha2(text.normalised(F.element_at(lines, -1)), 256), whole),
    }
    return merging.fence(docs, held, modes).select("doc_id", "match")


def passage_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many benchmark items each document holds anywhere in its text, word for word; those with none are inside the fence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = table(spark, sf_dir, "benchmark").select("item_id", "text")
    words = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    found = merging.holdings(docs, "doc_id", words, held, "item_id", words).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer."""
    orders = table(spark, sf_dir, "orders")
    return merging.last_of(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderstatus", "o_totalprice"])


_KEPT = "NOT (conv_id % 4 = 1 AND turn = conv_id % 3)"


def group_gapless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each conversation's turns are 0, 1, ... without a gap, where some have lost a turn."""
    return merging.gapless(table(spark, sf_dir, "conversations").where(_KEPT), "conv_id", "turn")


def pair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts of several documents that differ in source or language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", _identity().alias("identity"))
    groups = docs.groupBy("identity").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs"), F.min("doc_id").alias("first_id"))
    return groups.where("n_docs > 1 and (n_sources > 1 or n_langs > 1)")


def mixture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by source and language, with totals."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    return docs.rollup("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("sum_chars"), F.grouping_id().cast("long").alias("level"))


def caption_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cleaned and normalised, and whether it is a Latin caption."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.length(text.collapsed(F.col("text"))).cast("long").alias("n_clean"), F.md5(text.normalised(F.col("text"))).alias("normal_md5"), text.is_latin_caption(F.col("text")).alias("latin"))


def path_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of every page, with the language folder moved to the front of a local path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    path = text.url_path(F.col("url"))
    return pages.select("page_id", text.url_host(F.col("url")).alias("host"), F.regexp_replace(path, r"^/([a-z]{2})/", "/mirror/$1/").alias("path"))


QUERIES = {f.__name__: f for f in (dedup_precedence, strict_union, holdout_fence, passage_fence, upsert_latest, group_gapless, pair_audit, mixture_counts, caption_clean, path_rewrite)}

_ID = "sha256(lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g'))))"


def _collapsed(x: str) -> str:
    one = rf"trim(regexp_replace(coalesce({x}, ''), '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g'))"
    return f"CASE WHEN lower({one}) IN ('', 'none', 'n/a', 'na', 'null', 'nan', 'unknown') THEN '' ELSE {one} END"


def _folded(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def _normalised(x: str) -> str:
    return rf"regexp_replace({_folded(_collapsed(x))}, '[\s\.,;:!?。！？，；：…]+$', '')"


ORACLES = {
    "dedup_precedence": f"""
        SELECT identity, first(doc_id ORDER BY source, doc_id) AS doc_id, first(source ORDER BY source, doc_id) AS source, count(*) AS copies
        FROM (SELECT doc_id, source, {_ID} AS identity FROM documents) GROUP BY 1""",
    "strict_union": f"""
        WITH u AS (SELECT doc_id, source || ':' || least(n_chars, 1500) AS f FROM documents WHERE n_chars < 2000
                   UNION ALL SELECT doc_id, {_RENAMED} || ':' || least(n_chars, 1500) FROM documents WHERE n_chars >= 1000)
        SELECT doc_id, count(*) AS copies, count(DISTINCT f) > 1 AS conflict FROM u GROUP BY 1""",
    "holdout_fence": f"""
        WITH b AS (SELECT DISTINCT {_normalised("text")} AS t FROM benchmark WHERE text IS NOT NULL),
        p AS (SELECT doc_id, {_PUT} AS text FROM documents d LEFT JOIN (SELECT item_id, text AS b FROM benchmark) ON d.doc_id % {_ITEMS} = item_id),
        d AS (SELECT doc_id, {_normalised("text")} AS w, {_normalised("string_split(text, chr(10))[1]")} AS f, {_normalised("string_split(text, chr(10))[-1]")} AS l FROM p)
        SELECT doc_id, CASE WHEN w IN (SELECT t FROM b) THEN 'whole' WHEN f IN (SELECT t FROM b) THEN 'first' WHEN l IN (SELECT t FROM b) THEN 'last' END AS match FROM d""",
    "passage_fence": r"""
        WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE doc_id IS NOT NULL),
        b AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM benchmark WHERE item_id IS NOT NULL)
        SELECT doc_id, count(DISTINCT item_id) AS n_items FROM d LEFT JOIN b ON b.t <> '  ' AND contains(d.t, b.t) GROUP BY 1""",
    "upsert_latest": """
        SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus,
               arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, count(*) AS copies FROM orders GROUP BY 1""",
    "group_gapless": "SELECT conv_id, count(DISTINCT turn) AS n_index, min(turn) = 0 AND max(turn) + 1 = count(DISTINCT turn) AS complete FROM conversations WHERE turn IS NOT NULL AND " + _KEPT + " GROUP BY 1",
    "pair_audit": f"""
        SELECT identity, count(*) AS n_docs, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, min(doc_id) AS first_id
        FROM (SELECT doc_id, source, lang, {_ID} AS identity FROM documents) GROUP BY 1 HAVING count(*) > 1 AND (count(DISTINCT source) > 1 OR count(DISTINCT lang) > 1)""",
    "mixture_counts": "SELECT source, lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS sum_chars, grouping(source, lang) AS level FROM documents GROUP BY ROLLUP (source, lang)",
    "caption_clean": f"""
        SELECT doc_id, length({_collapsed("text")}) AS n_clean, md5({_normalised("text")}) AS normal_md5,
               regexp_matches({_collapsed("text")}, '[A-Za-z]') AND NOT regexp_matches({_collapsed("text")}, '[㐀-䶿一-鿿豈-﫿]') AS latin FROM documents""",
    "path_rewrite": r"""
        SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host,
               regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/([a-z]{2})/', '/mirror/\1/') AS path FROM pages""",
}
