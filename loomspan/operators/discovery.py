"""Episodes found in listings of folders, and inventories of them.

A listing has a row for each folder: root, folder (the path below it), depth, files (its
names) and real (the physical path). Rules that look at a folder beside another one are
joins of the listing with itself by path; nothing is asked of a file system.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.hashing import shard_of
from loomspan.operators.digests import table_digest
from loomspan.operators.ranking import global_rank

_HIERARCHY = "_hierarchy.json"
_INSTRUCTION = "instruction.json"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The folder around a path; empty at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _joined(folder: Column, name: Column | str) -> Column:
    """A path of a folder and a name; the name alone at the top."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def metadata_name(files: Column, episode: Column) -> Column:
    """(name, found): the file named as the episode, else the first JSON file that is nothing else; the former's name if there is neither."""
    exact = F.concat(episode, F.lit(".json"))
    other = lambda n: F.endswith(n, F.lit(".json")) & ~F.endswith(n, F.lit(".meta.json")) & ~F.endswith(n, F.lit(_HIERARCHY)) & ~n.isin(_INSTRUCTION, "instruction_meta.json")
    first = F.array_min(F.filter(files, other))
    return F.struct(F.when(F.array_contains(files, exact), exact).otherwise(F.coalesce(first, exact)).alias("name"), (F.array_contains(files, exact) | first.isNotNull()).alias("found"))


def _videos(files: Column) -> Column:
    return F.exists(files, lambda n: F.endswith(n, F.lit(".mp4")))


_JOB = ("source", "episode_key", "dataset", "episode", "root", "folder", "real", "kind", "hierarchy", "instruction", "metadata", "warnings")


def _job(df: DataFrame, source: str, kind: Column, key: Column | None = None, **more: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    key = F.col("folder") if key is None else key
    own = {"hierarchy": none, "instruction": none, "warnings": F.array().cast("array<string>")} | more
    return df.select(F.lit(source).alias("source"), key.alias("episode_key"), F.substring_index(key, "/", 1).alias("dataset"), "episode", "root", "folder", "real", kind.alias("kind"), *(own[c].alias(c) for c in ("hierarchy", "instruction")), own["metadata"].alias("metadata"), own["warnings"].alias("warnings"))


def _with_instruction(df: DataFrame, listing: DataFrame) -> DataFrame:
    """df and the path of the instruction file in each row's folder, else in the one around it."""
    held = listing.where(F.array_contains("files", _INSTRUCTION)).select("root", F.col("folder").alias("__around"), F.lit(True).alias("__above"))
    own = df.withColumn("__around", parent(F.col("folder"))).join(held, ["root", "__around"], "left")
    here = F.when(F.array_contains("files", _INSTRUCTION), _joined(F.col("folder"), _INSTRUCTION))
    return own.withColumn("instruction", F.coalesce(here, F.when(F.col("__above") & (F.col("folder") != ""), _joined(F.col("__around"), _INSTRUCTION)))).drop("__around", "__above")


def hierarchies(listing: DataFrame, source: str) -> DataFrame:
    """An episode for each *_hierarchy.json, with the instruction beside it or in the folder around it."""
    named = listing.select("*", F.explode(F.filter("files", lambda n: F.endswith(n, F.lit(_HIERARCHY)))).alias("__h"))
    named = named.withColumn("episode", F.regexp_replace("__h", "_hierarchy[.]json$", ""))
    own = _with_instruction(named, listing)
    return _job(own, source, F.lit("collection"), hierarchy=_joined(F.col("folder"), F.col("__h")), instruction=F.col("instruction"), metadata=_joined(F.col("folder"), metadata_name(F.col("files"), F.col("episode"))["name"]))


def flat_episodes(listing: DataFrame, source: str, topics: DataFrame | None = None) -> DataFrame:
    """An episode for each folder with a video and metadata.

    topics (root, topic, annotations) are the folders that a data list names, with where
    their annotations are; episodes of other folders look in the folder around them and
    are marked not_in_datalist.
    """
    own = listing.where(_videos(F.col("files")) & (F.col("folder") != "")).withColumn("episode", base_name(F.col("folder")))
    own = own.withColumn("__m", metadata_name(F.col("files"), F.col("episode"))).where("__m.found").withColumn("topic", parent(F.col("folder")))
    told = own.withColumn("annotations", F.lit(None).cast("string")) if topics is None else own.join(topics, ["root", "topic"], "left")
    warned = F.when(F.col("annotations").isNull(), F.array(F.lit("not_in_datalist"))).otherwise(F.array().cast("array<string>"))
    return _job(told, source, F.lit("flat"), instruction=F.coalesce("annotations", _joined(F.col("topic"), _INSTRUCTION)), metadata=_joined(F.col("folder"), F.col("__m.name")), warnings=warned)


def media_sweep(listing: DataFrame, source: str, annotated: DataFrame | None = None, depth: int | None = None, strip: int = 0) -> DataFrame:
    """An episode for each folder with a video, or for each one at a depth, empty ones too.

    strip names at the start of the path are no part of its key; paths that are no longer
    are left out. A hierarchy beside the videos counts as the annotation, with its
    instruction; else that of the key's topic among annotated (topic, path; the least
    rank of several), else an instruction in the folder. What is missing is told.
    """
    wanted = _videos(F.col("files")) if depth is None else F.col("depth") == depth
    own = listing.where(wanted & (F.col("depth") > strip)).withColumn("episode", base_name(F.col("folder")))
    key = F.array_join(F.slice(F.split("folder", "/"), F.lit(strip + 1), F.greatest(F.col("depth") - strip, F.lit(0))), "/")
    own = _with_instruction(own.withColumn("__key", key), listing).withColumn("__topic", parent(F.col("__key")))
    name = F.concat("episode", F.lit(_HIERARCHY))
    nested = F.array_contains("files", name)
    if annotated is None:
        own = own.withColumn("__told", F.lit(None).cast("string"))
    else:
        best = annotated.groupBy(F.col("topic").alias("__topic")).agg(F.min_by("path", F.struct("rank", "path")).alias("__told"))
        own = own.join(best, "__topic", "left")
    here = F.when(F.array_contains("files", _INSTRUCTION), _joined(F.col("folder"), _INSTRUCTION))
    own = own.withColumn("__m", metadata_name(F.col("files"), F.col("episode")))
    found = F.when(nested, F.col("instruction")).otherwise(F.coalesce("__told", here))
    warned = F.array_compact(F.array(F.lit("media_sweep"), F.when(~nested & found.isNull(), "no_annotation_found"), F.when(~F.col("__m.found"), "no_metadata_json")))
    return _job(own, source, F.when(nested, "collection").otherwise("flat"), F.col("__key"), hierarchy=F.when(nested, _joined(F.col("folder"), name)), instruction=found, metadata=_joined(F.col("folder"), F.col("__m.name")), warnings=warned)


def mirrored(annotations: DataFrame, listing: DataFrame, owners: DataFrame) -> DataFrame:
    """Episodes that annotations name, where the same path exists below a media root.

    annotations has (topic, episode, path), owners (source, rank, pattern, root, root_rank):
    the first source whose pattern fits the first name of the topic owns it, and the
    first of its roots that has the topic's folder is taken. An episode's folder has its
    name, or that behind ``episode_``; those without one are left out.
    """
    top = F.substring_index("topic", "/", 1)
    tops = annotations.select(top.alias("dataset")).distinct()
    rules = owners.select("source", "rank", "pattern").distinct()
    # a few patterns, each of which is tried on every first name
    fits = F.regexp_like("dataset", F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$")))
    owned = tops.join(F.broadcast(rules), fits).groupBy("dataset").agg(F.min_by("source", "rank").alias("source"))
    topics = annotations.select("topic", top.alias("dataset")).distinct().join(owned, "dataset")
    places = listing.select("root", F.col("folder").alias("topic"))
    chosen = topics.join(owners.select("source", "root", "root_rank"), "source").join(places, ["root", "topic"]).groupBy("topic", "dataset", "source").agg(F.min_by("root", "root_rank").alias("root"))
    own = annotations.join(chosen, "topic")
    names = F.array(F.col("episode"), F.concat(F.lit("episode_"), F.col("episode")))
    tried = own.select("*", F.posexplode(names).alias("__nth", "__name")).withColumn("folder", _joined(F.col("topic"), F.col("__name")))
    found = tried.join(listing.select("root", "folder", "files", "real"), ["root", "folder"])
    first = found.groupBy("source", "dataset", "topic", "episode", "path", "root").agg(F.min_by(F.struct("folder", "files", "real"), "__nth").alias("f"))
    flat = first.select("source", "episode", "root", "f.*", F.col("path").alias("instruction"))
    job = _job(flat, "", F.lit("flat"), instruction=F.col("instruction"), metadata=_joined(F.col("folder"), metadata_name(F.col("files"), F.col("episode"))["name"]))
    sources = flat.select("root", "folder", "episode", "instruction", F.col("source").alias("__s"))
    return job.join(sources, ["root", "folder", "episode", "instruction"]).withColumn("source", F.col("__s")).select(*_JOB)


def interleaved(jobs: list[DataFrame], most: int = 0) -> DataFrame:
    """(job, turn): the jobs of several sources in turns, each physical folder once, at its first turn; at most so many, if that is not 0.

    Within a source jobs come by their key. A job that is left out as a repeated one has
    used its source's turn.
    """
    every = reduce(DataFrame.unionByName, (df.withColumn("__source", F.lit(k)) for k, df in enumerate(jobs)))
    ranked, _ = global_rank(every, ["__source", "episode_key", "root", "folder", "episode"])
    first = ranked.groupBy("__source").agg(F.min("rank").alias("__first"))  # a row for each source
    placed = ranked.join(F.broadcast(first), "__source").withColumn("turn", F.col("rank") - F.col("__first")).drop("rank", "__first")
    once = placed.groupBy("real").agg(F.min_by(F.struct(*[c for c in placed.columns if c != "real"]), F.struct("turn", "__source")).alias("j")).select("real", "j.*")
    kept = once.orderBy("turn", "__source").limit(most) if most else once
    return kept.select(*_JOB, "turn")


def write_inventory(jobs: DataFrame, shards: int, path: str) -> DataFrame:
    """Jobs written in shards of their physical folder's hash; (shard, n, digest) of each, which is the same for any order of the jobs."""
    placed = jobs.withColumn("shard", shard_of(F.col("real"), shards))
    placed.write.partitionBy("shard").parquet(path)
    back = jobs.sparkSession.read.schema(placed.schema).parquet(path)
    return table_digest(back, ["source", "episode_key", "real", "kind"], ["shard"])


def listed_topics(topics: DataFrame, keys: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(source, topic, episode, episode_key) of the episodes that annotations have for a data list's topics; only allowed (topic, episode) where a topic has a list of those."""
    own = topics.join(keys, "topic")
    if allowed is not None:
        held = allowed.select("topic").distinct().withColumn("__some", F.lit(True))
        fits = allowed.select("topic", "episode", F.lit(True).alias("__fits")).distinct()
        own = own.join(held, "topic", "left").join(fits, ["topic", "episode"], "left").where("__some is null or __fits")
    tail = F.regexp_replace(F.regexp_replace("topic", "^/+|/+$", ""), "^[^/]*/", "")
    return own.select("source", "topic", "episode", F.concat_ws("/", "source", tail, "episode").alias("episode_key"))


def instruction_files(listing: DataFrame) -> DataFrame:
    """(root, path) of every instruction file."""
    return listing.where(F.array_contains("files", _INSTRUCTION)).select("root", _joined(F.col("folder"), _INSTRUCTION).alias("path"))


def device_roots(listing: DataFrame, prefix: str, depth: int = 3) -> DataFrame:
    """(device, roots): for each device's name at a depth all physical folders that it has, sorted; a device has a few."""
    own = listing.where((F.col("depth") == depth) & F.startswith(base_name(F.col("folder")), F.lit(prefix)))
    return own.groupBy(base_name(F.col("folder")).alias("device")).agg(F.array_sort(F.collect_set("real")).alias("roots"))
