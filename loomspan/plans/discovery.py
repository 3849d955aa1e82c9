"""Queries on listings of folders: every order is an episode's folder below its customer's topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import discovery
from loomspan.sources.jsonl import shared_path
from loomspan.sources.tables import table

_ROOT = "CONCAT('r', o_custkey % 3)"
_TOPIC = "CONCAT('ds', o_orderkey % 4, '/t', o_custkey % 5)"
_FOLDER = f"CONCAT({_TOPIC}, '/e', o_orderkey)"
#: one folder in eleven is another name of the one five before it
_REAL = "CONCAT('p/', CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 5 ELSE o_orderkey END)"
_E = "CONCAT('e', o_orderkey"
_FILES = (
    ("'a.mp4'", f"{_E}, '.json')", f"{_E}, '_hierarchy.json')", "'instruction.json'"), ("'face.mp4'", f"{_E}, '_hierarchy.json')"), ("'a.mp4'", "'b.json'", "'instruction.json'", "'z.json'"),
    (), ("'x.meta.json'", "'x.mp4'"), ("'note.txt'", "'other_hierarchy.json'"), ("'b.json'", "'x.mp4'"),
)
_NAMES = lambda opened, closed: f"CASE o_orderkey % {len(_FILES)} " + " ".join(f"WHEN {k} THEN {opened}{', '.join(names)}{closed}" for k, names in enumerate(_FILES) if names) + " END"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' folders, and their topics' with an instruction in every second one."""
    orders = table(spark, sf_dir, "orders")
    episodes = orders.select(F.expr(_ROOT).alias("root"), F.expr(_FOLDER).alias("folder"), F.lit(3).alias("depth"), F.coalesce(F.expr(_NAMES("array(", ")")), F.array().cast("array<string>")).alias("files"), F.expr(_REAL).alias("real"))
    topics = orders.select(F.expr(_ROOT).alias("root"), F.expr(_TOPIC).alias("folder"), F.lit(2).alias("depth"), F.when(F.col("o_custkey") % 5 % 2 == 0, F.array(F.lit("instruction.json"))).otherwise(F.array().cast("array<string>")).alias("files")).distinct()
    return episodes.unionByName(topics.withColumn("real", F.concat(F.lit("p/"), "root", F.lit("/"), "folder")))


def hierarchy_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with a hierarchy, and their instructions."""
    return discovery.hierarchies(listing(spark, sf_dir), "h").select("episode_key", "dataset", "episode", "root", "hierarchy", "instruction", "metadata")


def flat_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with videos and metadata; a data list names the topics of one root."""
    topics = listing(spark, sf_dir).where("depth = 2 and root = 'r1'").selectExpr("root", "folder AS topic", "concat('/labels/', folder, '.json') AS annotations")
    return discovery.flat_episodes(listing(spark, sf_dir), "f", topics).select("episode_key", "root", "instruction", "metadata", F.array_join("warnings", ",").alias("warnings"))


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = listing(spark, sf_dir).where("depth = 2 and folder not like '%t1'").selectExpr("substring_index(folder, '/', -1) AS topic").distinct()
    return topics.selectExpr("topic", "concat('/labels/', topic) AS path", "2 AS rank").unionByName(topics.where("topic = 't2'").selectExpr("topic", "concat('/better/', topic) AS path", "1 AS rank"))


def swept_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders with videos, keyed without their first name, and what they lack."""
    return discovery.media_sweep(listing(spark, sf_dir), "m", _annotated(spark, sf_dir), None, 1).select("episode_key", "root", "folder", "kind", "hierarchy", "instruction", "metadata", F.array_join("warnings", ",").alias("warnings"))


def swept_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folders at the third level, empty ones too, by what they lack."""
    return discovery.media_sweep(listing(spark, sf_dir), "d", None, 3).groupBy("kind", F.array_join("warnings", ",").alias("warnings")).agg(F.count(F.lit(1)).alias("n"))


_OWNERS = (("any", 3, "ds.*", "r2", 1), ("odd", 1, "ds[13]", "r0", 1), ("odd", 1, "ds[13]", "r1", 2), ("even", 2, "ds[02]", "r1", 1))


def mirrored_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of annotations below the first root that has their topic."""
    own = listing(spark, sf_dir).where("depth = 3")
    named = own.selectExpr("regexp_replace(folder, '/[^/]*$', '') AS topic", "substring_index(folder, '/', -1) AS name").distinct()
    annotations = named.selectExpr("topic", "CASE WHEN name LIKE '%7' THEN concat('no', name) ELSE name END AS episode", "concat('/labels/', topic) AS path")
    owners = spark.createDataFrame(list(_OWNERS), "source string, rank int, pattern string, root string, root_rank int")
    return discovery.mirrored(annotations, listing(spark, sf_dir), owners).select("source", "episode_key", "dataset", "root", "real", "instruction", "metadata")


def discovered_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 episodes of two sources in turns, each physical folder once."""
    own = listing(spark, sf_dir)
    return discovery.interleaved([discovery.hierarchies(own, "h"), discovery.media_sweep(own.where("root <> 'r2'"), "m")], 500).select("source", "episode_key", "root", "real", "turn")


def inventory_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of the episodes' inventory, written and read back."""
    jobs = discovery.interleaved([discovery.media_sweep(listing(spark, sf_dir), "m")])
    return discovery.write_inventory(jobs, 6, shared_path(spark))


def device_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All physical folders of the devices whose names begin with e1."""
    own = listing(spark, sf_dir).withColumn("folder", F.regexp_replace("folder", "e([0-9])[0-9]*$", "e$1"))
    return discovery.device_roots(own, "e1").select("device", F.array_join("roots", ",").alias("roots"))


def listed_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of the topics of a data list; one topic has a list of those that are allowed."""
    own = listing(spark, sf_dir)
    topics = own.where("depth = 2 and folder like 'ds1%'").selectExpr("'l' AS source", "folder AS topic").distinct()
    keys = own.where("depth = 3").selectExpr("regexp_replace(folder, '/[^/]*$', '') AS topic", "substring_index(folder, '/', -1) AS episode").distinct()
    return discovery.listed_topics(topics, keys, keys.where("topic = 'ds1/t2' and episode like '%1'"))


QUERIES = {f.__name__: f for f in (hierarchy_episodes, flat_episodes, swept_media, swept_depth, mirrored_episodes, discovered_episodes, inventory_shards, device_folders, listed_episodes)}

_L = f"""l AS (
        SELECT {_ROOT} AS root, {_FOLDER} AS folder, 3 AS depth, coalesce({_NAMES("[", "]")}, []::VARCHAR[]) AS files, {_REAL} AS real FROM orders
        UNION ALL SELECT DISTINCT {_ROOT}, {_TOPIC}, 2, CASE WHEN o_custkey % 5 % 2 = 0 THEN ['instruction.json'] ELSE []::VARCHAR[] END, 'p/' || {_ROOT} || '/' || {_TOPIC} FROM orders),
    e AS (SELECT *, string_split(folder, '/')[-1] AS ep, regexp_replace(folder, '/[^/]*$', '') AS topic FROM l),
    m AS (SELECT e.*, list_contains(files, ep || '.json') AS exact, list_min(list_filter(files, lambda n: ends_with(n, '.json') AND NOT ends_with(n, '.meta.json') AND NOT ends_with(n, '_hierarchy.json') AND n NOT IN ('instruction.json', 'instruction_meta.json'))) AS other,
        len(list_filter(files, lambda n: ends_with(n, '.mp4'))) > 0 AS video, list_contains(files, 'instruction.json') AS here, EXISTS (SELECT 1 FROM l a WHERE a.root = e.root AND a.folder = e.topic AND list_contains(a.files, 'instruction.json')) AS above FROM e)"""
_META = "folder || '/' || CASE WHEN exact THEN ep || '.json' ELSE coalesce(other, ep || '.json') END"
_TOLD = "CASE WHEN here THEN folder || '/instruction.json' WHEN above THEN topic || '/instruction.json' END"
_SWEPT = """
        t AS (SELECT DISTINCT string_split(folder, '/')[-1] AS topic FROM l WHERE depth = 2 AND folder NOT LIKE '%t1'),
        s AS (SELECT m.*, list_contains(files, ep || '_hierarchy.json') AS nested, CASE WHEN t.topic = 't2' THEN '/better/t2' ELSE '/labels/' || t.topic END AS told FROM m LEFT JOIN t ON t.topic = string_split(m.topic, '/')[-1])"""
_H = f"SELECT 'h' AS source, folder AS episode_key, root, folder, real, regexp_replace(h, '_hierarchy.json$', '') AS ep FROM (SELECT *, unnest(list_filter(files, lambda n: ends_with(n, '_hierarchy.json'))) AS h FROM m)"
ORACLES = {
    "hierarchy_episodes": f"""
        WITH {_L}, h AS (SELECT * EXCLUDE (ep), unnest(list_filter(files, lambda n: ends_with(n, '_hierarchy.json'))) AS h FROM m), n AS (SELECT *, regexp_replace(h, '_hierarchy.json$', '') AS ep FROM h)
        SELECT folder AS episode_key, string_split(folder, '/')[1] AS dataset, ep AS episode, root, folder || '/' || h AS hierarchy, {_TOLD} AS instruction,
            folder || '/' || CASE WHEN list_contains(files, ep || '.json') THEN ep || '.json' ELSE coalesce(other, ep || '.json') END AS metadata FROM n""",
    "flat_episodes": f"""
        WITH {_L} SELECT folder AS episode_key, root, CASE WHEN root = 'r1' THEN '/labels/' || topic || '.json' ELSE topic || '/instruction.json' END AS instruction, {_META} AS metadata, CASE WHEN root = 'r1' THEN '' ELSE 'not_in_datalist' END AS warnings
        FROM m WHERE video AND (exact OR other IS NOT NULL)""",
    "swept_media": f"""
        WITH {_L}, {_SWEPT}, i AS (SELECT *, CASE WHEN nested THEN {_TOLD} ELSE coalesce(told, CASE WHEN here THEN folder || '/instruction.json' END) END AS instruction FROM s WHERE video)
        SELECT regexp_replace(folder, '^[^/]*/', '') AS episode_key, root, folder, CASE WHEN nested THEN 'collection' ELSE 'flat' END AS kind, CASE WHEN nested THEN folder || '/' || ep || '_hierarchy.json' END AS hierarchy, instruction, {_META} AS metadata,
            concat_ws(',', 'media_sweep', CASE WHEN NOT nested AND instruction IS NULL THEN 'no_annotation_found' END, CASE WHEN NOT exact AND other IS NULL THEN 'no_metadata_json' END) AS warnings FROM i""",
    "swept_depth": f"""
        WITH {_L}, s AS (SELECT *, list_contains(files, ep || '_hierarchy.json') AS nested FROM m WHERE depth = 3)
        SELECT CASE WHEN nested THEN 'collection' ELSE 'flat' END AS kind, concat_ws(',', 'media_sweep', CASE WHEN NOT nested AND NOT here THEN 'no_annotation_found' END, CASE WHEN NOT exact AND other IS NULL THEN 'no_metadata_json' END) AS warnings, count(*) AS n FROM s GROUP BY 1, 2""",
    "mirrored_episodes": f"""
        WITH {_L}, o AS (SELECT * FROM (VALUES {", ".join(str(x) for x in _OWNERS)}) v(source, rank, pattern, root, root_rank)),
        a AS (SELECT DISTINCT topic, CASE WHEN ep LIKE '%7' THEN 'no' || ep ELSE ep END AS episode FROM m WHERE depth = 3),
        w AS (SELECT topic, arg_min(source, rank) AS source FROM (SELECT DISTINCT topic FROM a) x JOIN o ON regexp_full_match(string_split(topic, '/')[1], pattern) GROUP BY 1),
        c AS (SELECT w.topic, w.source, arg_min(o.root, o.root_rank) AS root FROM w JOIN o ON o.source = w.source JOIN l ON l.root = o.root AND l.folder = w.topic GROUP BY 1, 2)
        SELECT c.source, m.folder AS episode_key, string_split(m.folder, '/')[1] AS dataset, m.root, m.real, '/labels/' || a.topic AS instruction, {_META} AS metadata FROM a JOIN c USING (topic) JOIN m ON m.root = c.root AND m.folder = a.topic || '/' || a.episode""",
    "discovered_episodes": f"""
        WITH {_L}, j AS (SELECT *, 0 AS s FROM ({_H}) UNION ALL SELECT 'm', folder, root, folder, real, ep, 1 FROM m WHERE video AND root <> 'r2'),
        p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY episode_key, root, folder, ep) - 1 AS turn FROM j),
        f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY real ORDER BY turn, s) = 1)
        SELECT source, episode_key, root, real, turn FROM f ORDER BY turn, s LIMIT 500""",
    "inventory_shards": f"""
        WITH {_L}, j AS (SELECT 'm' AS source, folder AS episode_key, real, CASE WHEN list_contains(files, ep || '_hierarchy.json') THEN 'collection' ELSE 'flat' END AS kind, root FROM m WHERE video),
        f AS (SELECT *, (('0x' || substr(sha256(real), 1, 16))::UBIGINT % 6)::INT AS shard FROM j QUALIFY row_number() OVER (PARTITION BY real ORDER BY episode_key, root) = 1),
        h AS (SELECT *, sha256(strlen(source) || ':' || source || strlen(episode_key) || ':' || episode_key || strlen(real) || ':' || real || strlen(kind) || ':' || kind) AS h FROM f),
        x AS (SELECT *, ('0x' || substr(h, 1, 15))::BIGINT AS a, ('0x' || substr(h, 16, 15))::BIGINT AS b FROM h)
        SELECT shard, count(*) AS n, sha256(concat_ws('|', count(*), bit_xor(a), sum(a), bit_xor(b), sum(b))) AS digest FROM x GROUP BY 1""",
    "device_folders": f"""
        WITH {_L}, d AS (SELECT string_split(regexp_replace(folder, 'e([0-9])[0-9]*$', 'e\\1'), '/')[-1] AS device, real FROM l WHERE depth = 3)
        SELECT device, string_agg(DISTINCT real, ',' ORDER BY real) AS roots FROM d WHERE device LIKE 'e1%' GROUP BY 1""",
    "listed_episodes": f"""
        WITH {_L} SELECT DISTINCT 'l' AS source, topic, ep AS episode, 'l/' || regexp_replace(topic, '^[^/]*/', '') || '/' || ep AS episode_key FROM m WHERE depth = 3 AND topic LIKE 'ds1%' AND (topic <> 'ds1/t2' OR ep LIKE '%1')""",
}
