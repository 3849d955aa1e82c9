"""Queries on references, sizes, estimates and small readings of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import refs
from loomspan.sources.tables import table


def _by(*cases: str) -> str:
    return f"CASE p_partkey % {len(cases)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END"


_REF = _by("""'" ' || p_name || '.mp4"'""", """'{"path":"' || p_name || '","start_frame":' || p_size || '}'""", """'{"video":"v","end_frame":9,"start_frame":null}'""", """'{"path":"a","start_frame":true}'""", """'{"path":7,"video":"v"}'""", "'\"\"'", "'[1]'", "NULL", """'{"path":"a","end_frame":1.5}'""")
_PATH = _by("p_name || '.mp4'", "p_name", "'v'", *["NULL"] * 6)
_IMAGES = _by("""'"a"'""", """'[null,"b"," ",{"p":' || p_size || '}]'""", "'null'", "NULL", "'7'", """'{"q":1}'""", "'[]'")
_LISTED = _by("""'"a"'""", """'"b"|{"p":' || p_size || '}'""", "''", "''", "NULL", """'{"q":1}'""", "''")


def video_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and frames of references written in several ways."""
    return table(spark, sf_dir, "part").select("p_partkey", refs.video_ref(F.expr(_REF)).alias("r")).select("p_partkey", "r.*")


def image_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images that a field refers to."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(refs.image_refs(F.expr(_IMAGES)), "|").alias("images"))


def resized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that images of all shapes are made smaller to."""
    own = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_partkey * 3 + 8 AS h", "l_suppkey * 40 + 20 AS w")
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "w", refs.resized(F.col("h"), F.col("w")).alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "w", "r.*")


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of every document with some images."""
    return table(spark, sf_dir, "documents").select("doc_id", refs.context_tokens(F.col("n_chars"), F.col("doc_id") % 4).alias("tokens"))


_FAILED = _by("' 1.1 arm stays'", "'8.1'", "'2.3 none'", "'4.25'", "p_name", "NULL", "'7.1: grip'")


def failure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of failures at the beginning of their texts."""
    return table(spark, sf_dir, "part").select("p_partkey", refs.failure_code(F.expr(_FAILED)).alias("code"))


_RATE = _by("p_size || '/' || (p_partkey % 12)", "p_size || '.50'", "' ' || p_size", "'-3'", "'1e5'", "'0'", "(p_size * 6) || '/' || (p_size * 4)")


def fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates as fractions in lowest terms."""
    return table(spark, sf_dir, "part").select("p_partkey", refs.fraction(F.expr(_RATE)).alias("f")).select("p_partkey", "f.*")


def merge_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of every order as a sample."""
    views = F.expr("CASE o_orderkey % 3 WHEN 0 THEN array('side', 'head') WHEN 1 THEN array('left') END")
    return table(spark, sf_dir, "orders").select("o_orderkey", refs.merge_identity(F.concat(F.lit("/m/"), "o_custkey"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")), F.lit("L1"), F.col("o_orderstatus"), views).alias("identity"))


QUERIES = {f.__name__: f for f in (video_refs, image_lists, resized_images, token_estimates, failure_codes, fractions, merge_identities)}
ORACLES = {
    "video_refs": f"SELECT p_partkey, {_PATH} AS path, ({_by('NULL', 'p_size', *['NULL'] * 7)})::BIGINT AS start, ({_by('NULL', 'NULL', '9', *['NULL'] * 6)})::BIGINT AS end FROM part",
    "image_lists": f"SELECT p_partkey, {_LISTED} AS images FROM part",
    "resized_images": """
        WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey * 3 + 8 AS h, l_suppkey * 40 + 20 AS w FROM lineitem), b AS (SELECT *, least(1.0::DOUBLE, 640.0::DOUBLE / greatest(h, w)) AS s FROM a),
        c AS (SELECT *, CASE WHEN (h * s) * (w * s) > 589824 THEN sqrt(589824.0::DOUBLE / ((h * s) * (w * s))) ELSE 1.0 END AS k FROM b)
        SELECT l_orderkey, l_linenumber, l_partkey, w, CASE WHEN h >= 32 AND w >= 32 THEN greatest(32, floor(h * s * k / 32) * 32)::INT END AS height, CASE WHEN h >= 32 AND w >= 32 THEN greatest(32, floor(w * s * k / 32) * 32)::INT END AS width FROM c""",
    "token_estimates": "SELECT doc_id, (n_chars + 2) // 3 + 400 * (doc_id % 4) + 256 AS tokens FROM documents",
    "failure_codes": f"SELECT p_partkey, {_by(*(f'{chr(39)}{c}{chr(39)}' if c else 'NULL' for c in ('1.1', '8.1', None, None, None, None, '7.1')))} AS code FROM part",
    "fractions": f"""
        WITH f AS (SELECT p_partkey, {_by("p_size", "p_size * 100 + 50", "p_size", "NULL", "NULL", "NULL", "p_size * 6")} AS a, {_by("p_partkey % 12", "100", "1", "NULL", "NULL", "NULL", "p_size * 4")} AS b FROM part)
        SELECT p_partkey, CASE WHEN a > 0 AND b > 0 THEN a // gcd(a, b) END AS numerator, CASE WHEN a > 0 AND b > 0 THEN b // gcd(a, b) END AS denominator FROM f""",
    "merge_identities": """
        SELECT o_orderkey, sha256('{"anchor_index":' || CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey::VARCHAR ELSE 'null' END || ',"media_realpath":"/m/' || o_custkey || '","profile":"' || o_orderstatus || '","unit_level":"L1","views":'
            || CASE o_orderkey % 3 WHEN 0 THEN '["head","side"]' WHEN 1 THEN '["left"]' ELSE '[]' END || '}') AS identity FROM orders""",
}
