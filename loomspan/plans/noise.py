"""Queries on contexts: every order is a sample with its lines as memory and plan, its customer an episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.hashing import joined
from loomspan.operators import noise
from loomspan.sources.tables import table

_KEY = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*_KEY, F.col("l_returnflag").alias("f"), F.col("l_partkey").cast("string").alias("p")).alias("x")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").join(lines, "o_orderkey", "left")
    caption = lambda c: F.when(F.col("o_orderkey") % c == 0, F.struct(F.lit("c").alias("caption"), (F.col("o_custkey") % 101).cast("int").alias("progress")))
    short = F.when(F.col("o_orderkey") % 7 != 0, F.struct((F.col("o_orderkey") % 101).cast("int").alias("task_progress"), caption(2).alias("action"), caption(3).alias("segment")))
    return own.select(
        F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("episode"), F.col("o_orderpriority").alias("profile"), F.when(F.col("o_orderkey") % 2 == 0, "with_memory_with_initial_noisy").otherwise("with_memory_no_initial_noisy").alias("name"), F.col("o_orderstatus").alias("side"),
        F.transform("x", lambda x: F.struct(x["p"].alias("action"), x["f"].alias("segment"))).alias("long"), short.alias("short"), F.transform("x", lambda x: F.struct(x["p"].alias("caption"), F.array(x["f"]).alias("segments"))).alias("plan"),
    )


_SHOWN = lambda c: F.array_join(F.transform(c, lambda x: x["action"]), ",")


def noisy_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample's damaged context; donors are the samples of finished orders."""
    own = _samples(spark, sf_dir)
    seed = noise.Seed(joined(F.col("sample"), F.col("name"), noise.VERSION))
    given = noise.donated(own, own.where("side = 'F'"), "episode", "profile", seed)
    n = F.col("noise")
    out = noise.noisy(given, "sample", "name", "long", "short", "plan", "donor")
    unit = lambda u: F.coalesce(n["short"][u]["progress"].cast("string"), F.lit("-"))
    short = F.concat_ws(":", n["short"]["task_progress"], F.when(n["short"].isNotNull(), unit("action")), F.when(n["short"].isNotNull(), unit("segment")))
    return out.select("sample", n["kind"].alias("kind"), _SHOWN(n["long"]).alias("long"), short.alias("short"), n["plan_kind"].alias("plan_kind"), n["plan_at"].alias("plan_at"), n["plan_other"].alias("plan_other"), F.array_join(F.transform(n["plan"], lambda x: x["caption"]), ",").alias("plan"), n["changed"].alias("changed"), F.when(n["kind"].startswith("cross"), F.col("donor.sample")).alias("donor"))


def clean_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts that each sample allows."""
    own = _samples(spark, sf_dir).withColumn("long", F.when(F.col("sample") % 5 != 0, F.col("long")))
    return noise.clean_contexts(own, "long", "plan").select("sample", "context")


def noise_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of damage at each event as a training step."""
    return table(spark, sf_dir, "events").select("event_id", F.round(noise.noise_probability(F.col("event_id") - 10, 0.3, 400), 9).alias("probability"))


def augmented_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often memories are damaged in which way, and how their sizes change."""
    own = _samples(spark, sf_dir).where("long is not null")
    items = F.transform("long", lambda x: x["action"])
    out = own.select(F.size(items).alias("n"), noise.augmented(items, F.col("sample"), F.lit(0.5)).alias("a"))
    return out.groupBy("a.operation").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("a.items") - F.col("n")).alias("more"))


QUERIES = {f.__name__: f for f in (noisy_contexts, clean_contexts, noise_schedule, augmented_memories)}

_OF = "(('0x' || substr(sha256(sample || chr(0) || name || chr(0) || 'context-noise-v1'), 1, 16))::UBIGINT)"
_S = f"""l AS (SELECT l_orderkey AS sample, list(l_partkey::VARCHAR ORDER BY {", ".join(_KEY)}) AS x FROM lineitem GROUP BY 1),
    s AS (SELECT o_orderkey AS sample, o_custkey AS episode, o_orderpriority AS profile, CASE WHEN o_orderkey % 2 = 0 THEN 'with_memory_with_initial_noisy' ELSE 'with_memory_no_initial_noisy' END AS name, o_orderstatus AS side, x, o_orderkey % 7 <> 0 AS has,
        o_orderkey % 101 AS tp, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 101 END AS ap, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 101 END AS sp FROM orders LEFT JOIN l ON l.sample = o_orderkey),
    k AS (SELECT *, {_OF} AS seed, {_OF} >> 11 AS seed2 FROM s)"""
_NEW = lambda old, bits: f"CASE WHEN {old} IS NULL THEN NULL WHEN (seed >> {bits}) % 101 = {old} THEN ({old} + 1) % 101 ELSE (seed >> {bits}) % 101 END"
ORACLES = {
    "noisy_contexts": f"""
        WITH {_S}, d AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY episode, sample) - 1 AS r FROM s WHERE side = 'F' AND has),
        e AS (SELECT k.*, (SELECT count(*) FROM d WHERE d.profile = k.profile AND d.episode <> k.episode) AS m FROM k),
        f AS (SELECT e.*, CASE WHEN m > 0 THEN (seed % greatest(m, 1))::BIGINT END AS j FROM e),
        a AS (SELECT f.*, (SELECT min(r) FROM d WHERE d.profile = f.profile AND d.episode = f.episode) AS first, (SELECT count(*) FROM d WHERE d.profile = f.profile AND d.episode = f.episode) AS own FROM f),
        b AS (SELECT a.*, d.sample AS ds, d.tp AS dt, d.ap AS da, d.sp AS dp FROM a LEFT JOIN d ON d.profile = a.profile AND d.r = CASE WHEN first IS NOT NULL AND j >= first THEN j + own ELSE j END),
        c AS (SELECT *, list_filter(CASE seed % 3 WHEN 0 THEN ['p', 'w', 'd'] WHEN 1 THEN ['w', 'd', 'p'] ELSE ['d', 'p', 'w'] END, lambda z: CASE z WHEN 'p' THEN has WHEN 'w' THEN coalesce(len(x), 0) >= 2 ELSE ds IS NOT NULL END)[1] AS way FROM b),
        n AS (SELECT *, CASE way WHEN 'p' THEN {_NEW("tp", 0)} WHEN 'd' THEN dt WHEN 'w' THEN CASE WHEN has THEN tp END END AS nt,
            CASE way WHEN 'p' THEN {_NEW("ap", 7)} WHEN 'd' THEN da WHEN 'w' THEN CASE WHEN has THEN ap END END AS na, CASE way WHEN 'p' THEN CASE WHEN ap IS NULL THEN {_NEW("sp", 7)} ELSE {_NEW("sp", 14)} END WHEN 'd' THEN dp WHEN 'w' THEN CASE WHEN has THEN sp END END AS ns,
            CASE WHEN way = 'w' THEN CASE WHEN seed % 2 = 0 THEN x[:-2] ELSE x[2:] END WHEN way IS NOT NULL THEN x END AS nl, len(x) AS c, greatest(len(x), 2) AS g, way = 'd' OR way = 'p' AND has OR way = 'w' AND has AS shown FROM c),
        p AS (SELECT *, CASE WHEN c >= 1 THEN CASE WHEN c = 1 THEN 'initial_plan_duplicate_single' WHEN seed2 % 3 = 0 THEN 'initial_plan_drop' WHEN seed2 % 3 = 1 THEN 'initial_plan_adjacent_swap' ELSE 'initial_plan_step_replace' END END AS pk,
            (seed2 % g)::INT AS spot, (seed2 % (g - 1))::INT AS lf, (((seed2 % g)::BIGINT + 1 + ((seed2 >> 8) % (g - 1))::BIGINT) % g)::INT AS src FROM n),
        q AS (SELECT *, CASE pk WHEN 'initial_plan_duplicate_single' THEN list_concat(x, x) WHEN 'initial_plan_drop' THEN list_filter(x, lambda z, i: i <> spot + 1) WHEN 'initial_plan_adjacent_swap' THEN list_transform(x, lambda z, i: CASE WHEN i = lf + 1 THEN x[lf + 2] WHEN i = lf + 2 THEN x[lf + 1] ELSE z END)
            WHEN 'initial_plan_step_replace' THEN list_transform(x, lambda z, i: CASE WHEN i = spot + 1 THEN x[src + 1] ELSE z END) END AS np FROM p)
        SELECT sample, CASE way WHEN 'p' THEN 'progress_0_100' WHEN 'w' THEN 'causal_window_shift' WHEN 'd' THEN 'cross_train_episode_short_memory' END AS kind, array_to_string(nl, ',') AS long,
            CASE WHEN shown THEN nt || ':' || coalesce(na::VARCHAR, '-') || ':' || coalesce(ns::VARCHAR, '-') ELSE '' END AS short, pk AS plan_kind,
            CASE pk WHEN 'initial_plan_duplicate_single' THEN 1 WHEN 'initial_plan_adjacent_swap' THEN lf + 1 WHEN 'initial_plan_drop' THEN spot + 1 WHEN 'initial_plan_step_replace' THEN spot + 1 END AS plan_at, CASE pk WHEN 'initial_plan_adjacent_swap' THEN lf + 2 WHEN 'initial_plan_step_replace' THEN src + 1 END AS plan_other,
            array_to_string(np, ',') AS plan, way IS NOT NULL AND (way <> 'd' OR dt <> tp OR NOT has OR coalesce(da, -1) <> coalesce(ap, -1) OR coalesce(dp, -1) <> coalesce(sp, -1) OR np IS DISTINCT FROM x) AS changed, CASE WHEN way = 'd' THEN ds END AS donor FROM q""",
    "clean_contexts": f"""
        WITH {_S} SELECT sample, unnest(CASE WHEN sample % 5 = 0 OR x IS NULL THEN ['no_memory_no_initial'] ELSE ['no_memory_no_initial', 'with_memory_no_initial', 'with_memory_with_initial'] END) AS context FROM s""",
    "noise_schedule": "SELECT event_id, round(CASE WHEN event_id <= 10 THEN 0 ELSE least(0.3, 0.3 * (event_id - 10) / 400) END, 9) AS probability FROM events",
}
