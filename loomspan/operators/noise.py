"""Contexts of prompts: the clean ones that a row allows, and deterministic damage to them.

What is damaged and how is decided by 64 bits of a hash of the sample, its context's name
and the noise's version, so a row's noise is the same on every machine. Memories are
arrays: long is array<struct<action:string,segment:string>> in order, short a struct of
task_progress and the units action and segment (each caption and progress, null if it is
not there), plan array<struct<caption:string,segments:array<string>>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.hashing import joined
from loomspan.functions.text import bound
from loomspan.operators.ranking import global_rank

VERSION = "context-noise-v1"
SHORT = "struct<task_progress:int,action:struct<caption:string,progress:int>,segment:struct<caption:string,progress:int>>"
_CLEAN = ("no_memory_no_initial", "with_memory_no_initial", "with_memory_with_initial")


class Seed:
    """The 64 bits as two halves; shifted to the right by so many bits."""

    def __init__(self, text: Column | None, shift: int = 0, halves: Column | None = None):
        self.shift = shift
        self.halves = bound(F.sha2(text, 256), lambda d: F.struct(*(F.conv(F.substring(d, k, 8), 16, 10).cast("bigint").alias(name) for k, name in ((1, "high"), (9, "low"))))) if halves is None else halves
        self.high, self.low = self.halves["high"], self.halves["low"]

    def __rshift__(self, bits: int) -> Seed:
        return Seed(None, self.shift + bits, self.halves)

    def __mod__(self, n: Column | int) -> Column:
        """The remainder by a number below 2**31."""
        n = n.cast("bigint") if isinstance(n, Column) else F.lit(n).cast("bigint")
        upper = F.pmod(F.pmod(self.high, n) * F.pmod(F.lit(1 << (32 - self.shift)).cast("bigint"), n), n)
        return F.pmod(upper + F.pmod(F.shiftright(self.low, self.shift), n), n)


def _other(old: Column, seed: Seed) -> Column:
    """Another progress than old."""
    new = (seed % 101).cast("int")
    return F.when(new == old, F.pmod(new + 1, F.lit(101))).otherwise(new)


def progress_noise(short: Column, seed: Seed) -> Column:
    """The short memory with other progress throughout; null without one."""

    def unit(name: str, place: Column) -> Column:
        own = short[name]
        by = F.when(place == 1, _other(own["progress"], seed >> 7)).otherwise(_other(own["progress"], seed >> 14))
        return F.when(own.isNotNull(), F.struct(own["caption"].alias("caption"), by.alias("progress"))).alias(name)

    second = F.when(short["action"].isNotNull(), 2).otherwise(1)
    return F.when(short.isNotNull(), F.struct(_other(short["task_progress"], seed).alias("task_progress"), unit("action", F.lit(1)), unit("segment", second)))


def window_noise(long: Column, seed: Seed) -> Column:
    """The long memory without its last item, or without its first one; null for fewer than two."""
    n = F.size(long)
    return F.when(n >= 2, F.when(seed % 2 == 0, F.slice(long, F.lit(1), n - 1)).otherwise(F.slice(long, F.lit(2), n - 1)))


def plan_noise(plan: Column, seed: Seed) -> Column:
    """(kind, at, other, plan): one step dropped, two neighbours swapped or a step replaced by another; a single step doubled."""
    n = F.size(plan)
    many = F.greatest(n, F.lit(2))
    at, left = seed % many, seed % (many - 1)
    source = F.pmod(at + 1 + ((seed >> 8) % (many - 1)), many)
    item = lambda k: F.get(plan, k.cast("int"))
    mode = seed % 3
    place = F.when(n == 1, 0).when(mode == 1, left).otherwise(at).cast("int")
    other = F.when(n == 1, F.lit(None).cast("int")).when(mode == 1, left + 1).when(mode == 2, source).cast("int")
    swapped = F.transform(plan, lambda x, i: F.when(i == left, item(left + 1)).when(i == left + 1, item(left)).otherwise(x))
    changed = F.when(n == 1, F.concat(plan, plan)).when(mode == 0, F.filter(plan, lambda x, i: i != at)).when(mode == 1, swapped).otherwise(F.transform(plan, lambda x, i: F.when(i == at, item(source)).otherwise(x)))
    kind = F.when(n == 1, "initial_plan_duplicate_single").when(mode == 0, "initial_plan_drop").when(mode == 1, "initial_plan_adjacent_swap").otherwise("initial_plan_step_replace")
    return F.when(n >= 1, F.struct(kind.alias("kind"), (place + 1).alias("at"), (other + 1).alias("other"), changed.alias("plan")))


def donated(df: DataFrame, donors: DataFrame, episode: str, profile: str, seed: Seed) -> DataFrame:
    """df and ``donor``: (sample, episode, short) of the donor that the seed picks among those of the profile in other episodes; null if there is none.

    donors has sample, episode, profile and short. They are ranked by profile, episode
    and sample; an episode's own ones stand together there, so the one that is meant is
    found by its rank, without a list of them.
    """
    ranked, _ = global_rank(donors.where("short is not null").select("profile", "episode", "sample", "short"), ["profile", "episode", "sample"])
    starts = ranked.groupBy("profile").agg(F.min("rank").alias("__start"), F.count(F.lit(1)).alias("__n"))
    own = ranked.groupBy("profile", "episode").agg(F.min("rank").alias("__first"), F.count(F.lit(1)).alias("__own"))
    named = lambda t, *keys: t.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in t.columns if c.startswith("__")))
    # one row for each profile: dealt out by it, a profile's rows would all be one task's
    out = df.join(F.broadcast(named(starts, "profile")), F.col(profile) == F.col("__profile"), "left").drop("__profile")
    out = out.join(named(own, "profile", "episode"), (F.col(profile) == F.col("__profile")) & (F.col(episode) == F.col("__episode")), "left").drop("__profile", "__episode")
    left = F.col("__n") - F.coalesce("__own", F.lit(0))
    place = F.col("__start") + seed % F.greatest(left, F.lit(1))
    rank = F.when(left > 0, F.when(place >= F.col("__first"), place + F.col("__own")).otherwise(place))
    given = ranked.select(F.col("rank").alias("__rank"), F.struct("sample", "episode", "short").alias("donor"))
    return out.withColumn("__at", rank).join(given, F.col("__at") == F.col("__rank"), "left").drop("__start", "__n", "__first", "__own", "__at", "__rank")


def noisy(df: DataFrame, sample: str, context: str, long: str, short: str, plan: str | None = None, donor: str | None = None) -> DataFrame:
    """df and ``noise``: (kind, long, short, plan_kind, plan_at, plan_other, plan, changed).

    The kinds progress_0_100, causal_window_shift and cross_train_episode_short_memory
    are tried from the one that the seed prefers on; one that can't be done passes to the
    next. With a plan, that is damaged too. donor is the column of ``donated``. changed
    tells whether anything is another than before; where nothing can be done, kind is null.
    """
    columns = df.columns
    # hashed once for all that is decided by it
    df = df.withColumn("__seed", Seed(joined(F.col(sample), F.col(context), VERSION)).halves)
    seed = Seed(None, 0, F.col("__seed"))
    ways = {
        "progress_0_100": (F.col(long), progress_noise(F.col(short), seed), F.col(short).isNotNull()),
        "causal_window_shift": (window_noise(F.col(long), seed), F.col(short), F.size(F.coalesce(F.col(long), F.array())) >= 2),
        "cross_train_episode_short_memory": (F.col(long), F.col(f"{donor}.short") if donor else F.col(short), F.col(donor).isNotNull() if donor else F.lit(False)),
    }
    names = list(ways)
    chosen = F.lit(None).cast("string")
    for first in range(3):
        order = [names[(first + k) % 3] for k in range(3)]
        kind = F.coalesce(*(F.when(ways[k][2], F.lit(k)) for k in order))
        chosen = F.when(seed % 3 == first, kind).otherwise(chosen)
    out = df.withColumn("__kind", chosen)
    pick = lambda part: F.when(F.col("__kind") == names[0], ways[names[0]][part]).when(F.col("__kind") == names[1], ways[names[1]][part]).when(F.col("__kind") == names[2], ways[names[2]][part])
    out = out.withColumns({"__long": pick(0), "__short": pick(1)})
    changed = ~(F.col("__long").eqNullSafe(F.col(long)) & F.col("__short").eqNullSafe(F.col(short)))
    if plan is None:
        parts = F.struct(F.col("__kind").alias("kind"), F.col("__long").alias("long"), F.col("__short").alias("short"), F.coalesce(F.col("__kind").isNotNull() & changed, F.lit(False)).alias("changed"))
    else:
        out = out.withColumn("__plan", plan_noise(F.col(plan), seed >> 11))
        changed = changed | ~F.col("__plan.plan").eqNullSafe(F.col(plan))
        parts = F.struct(
            F.col("__kind").alias("kind"), F.col("__long").alias("long"), F.col("__short").alias("short"), F.col("__plan.kind").alias("plan_kind"), F.col("__plan.at").alias("plan_at"), F.col("__plan.other").alias("plan_other"),
            F.col("__plan.plan").alias("plan"), F.coalesce(F.col("__kind").isNotNull() & changed, F.lit(False)).alias("changed"),
        )
    return out.withColumn("noise", parts).select(*columns, "noise")


def clean_contexts(df: DataFrame, long: str, plan: str) -> DataFrame:
    """A row for each context that a row's memories allow: without memory always, with one where there is a long memory, with the plan too where that isn't empty."""
    allowed = F.array_compact(F.array(F.lit(_CLEAN[0]), F.when(F.col(long).isNotNull(), F.lit(_CLEAN[1])), F.when(F.col(long).isNotNull() & (F.size(F.coalesce(F.col(plan), F.array())) > 0), F.lit(_CLEAN[2]))))
    return df.withColumn("context", F.explode(allowed))


def noise_probability(step: Column, most: float, ramp: int) -> Column:
    """Of damage at a training step: it grows evenly to most over ramp steps."""
    return F.when(step <= 0, 0.0).otherwise(F.lit(most) if ramp <= 0 else F.least(F.lit(most), most * step / ramp))


_OPERATIONS = ("drop", "replace", "duplicate", "empty")


def augmented(items: Column, key: Column, probability: Column) -> Column:
    """(items, operation): a memory that is damaged with some probability, by a hash of the key: an item dropped, replaced by another, doubled, or all gone.

    gt: left as it is; replace_skipped: there is no other item. Each operation is as
    likely; the draws are of the hash, not of another generator's sequence.
    """
    given = F.struct(items.alias("items"), Seed(joined(key, "augment-v1")).halves.alias("seed"))
    return bound(given, lambda x: _placed(x["items"], Seed(None, 0, x["seed"]), probability))


def _placed(items: Column, seed: Seed, probability: Column) -> Column:
    at = (seed >> 20) % F.greatest(F.size(items), F.lit(1))
    return bound(F.struct(at.alias("at"), F.get(items, at.cast("int")).alias("hit")), lambda x: _others(items, seed, probability, x["at"], F.filter(items, lambda y: y != x["hit"])))


def _others(items: Column, seed: Seed, probability: Column, at: Column, others: Column) -> Column:
    chosen = bound(others, lambda o: F.get(o, ((seed >> 24) % F.greatest(F.size(o), F.lit(1))).cast("int")))
    return bound(F.struct(chosen.alias("other")), lambda x: _damaged(items, seed, probability, at, x["other"]))


def _damaged(items: Column, seed: Seed, probability: Column, at: Column, other: Column) -> Column:
    draw = (seed % 1_000_003) / 1_000_003.0
    go = (F.size(items) > 0) & (draw < probability)
    which = (seed >> 12) % len(_OPERATIONS)
    done = F.when(which == 0, F.filter(items, lambda x, i: i != at)).when(which == 1, F.transform(items, lambda x, i: F.when((i == at) & other.isNotNull(), other).otherwise(x))).when(which == 2, F.flatten(F.transform(items, lambda x, i: F.when(i == at, F.array(x, x)).otherwise(F.array(x))))).otherwise(F.array().cast("array<string>"))
    name = F.when((which == 1) & other.isNull(), "replace_skipped").otherwise(F.get(F.array(*map(F.lit, _OPERATIONS)), which.cast("int")))
    return F.struct(F.when(F.coalesce(go, F.lit(False)), done).otherwise(items).alias("items"), F.when(F.coalesce(go, F.lit(False)), name).otherwise("gt").alias("operation"))
