"""Scores of model targets leaf by leaf, reports of them, runs' roll-ups, and rows picked for review."""

from __future__ import annotations

import json
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import contracts
from loomspan.operators.ranking import global_rank
from loomspan.streaming.memory import canonical


def _leaves(said: dict, true: dict, fields: tuple[str, ...]) -> list[bool]:
    """Whether each leaf is equal; all are wrong of a prediction that one side lacks."""
    alike = lambda a, b: canonical(a["caption"]) == canonical(b["caption"])
    same = lambda a, b, name: a[name] == b[name]
    out = [alike(said["task"], true["task"]), same(said["task"], true["task"], "progress_percent"), len(said["predictions"]) == len(true["predictions"])]
    for a, b in zip_longest(said["predictions"], true["predictions"]):
        for field in fields:
            more = ["source"] if field == "l0" else []
            if a is None or b is None:
                out += [False] * (2 + len(more))
            else:
                out += [alike(a[field], b[field]), *(same(a[field], b[field], name) for name in ["progress_percent", *more])]
    return out


def _scored(text: pd.Series, target: pd.Series, profile: pd.Series) -> pd.DataFrame:
    rows = []
    for said, true, name in zip(text, target, profile, strict=True):
        try:
            right = _leaves(json.loads(said), json.loads(true), contracts.PROFILES[name])
        except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
            rows.append((0.0, False, False, 0, 1, "target"))
        else:
            rows.append((sum(right) / len(right), all(right), True, sum(right), len(right), None))
    return pd.DataFrame(rows, columns=["score", "exact", "valid", "matched", "total", "error"], dtype=object)


def target_scores(df: DataFrame, text: str, target: str, profile: str) -> DataFrame:
    """df and ``scored`` (score, exact, valid, matched, total, error): the share of a target's leaves that a text has right.

    Leaves are the task's caption and progress, the number of predictions, and of each
    field of each prediction caption, progress and, of the lowest level, source. Captions
    are equal when normalised. Leaves of a prediction that one side lacks are wrong. A
    text that breaks the target's contract scores 0 of 1, with the rule it breaks; so
    does one whose target can't be read (target).
    """
    said = F.trim(text)
    kind = "score double, exact boolean, valid boolean, matched int, total int, error string"
    own = df.withColumns({"__broken": contracts.level_target(said, F.col(profile)), "__scored": F.pandas_udf(_scored, kind)(said, target, profile)})
    # what breaks the contract counts, whatever its leaves are
    broken = F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("exact"), F.lit(False).alias("valid"), F.lit(0).alias("matched"), F.lit(1).alias("total"), F.col("__broken").alias("error"))
    return own.withColumn("scored", F.when(F.col("__broken").isNotNull(), broken).otherwise(F.col("__scored"))).drop("__broken", "__scored")


def score_report(df: DataFrame, score: str, top: int = 10) -> DataFrame:
    """One row: samples, mean score, shares of exact and valid ones, and the most frequent errors (ties by name) as name:count."""
    own = df.select(f"{score}.*")
    rate = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    # all samples and each error's in one pass, as a score may be costly; a filter or a second pass would work it out again
    sums = own.rollup("error").agg(F.grouping("error").alias("all"), F.count(F.lit(1)).alias("n"), rate("score").alias("score"), rate(F.col("exact").cast("int")).alias("exact"), rate(F.col("valid").cast("int")).alias("valid"))
    # the row of all, then the errors, then what has none
    kept = sums.orderBy(F.desc("all"), F.col("error").isNull(), F.desc("n"), "error").limit(top + 1)
    whole = lambda c, none: F.coalesce(F.max(F.when(F.col("all") == 1, F.col(c))), F.lit(none))
    told = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct((-F.col("n")).alias("m"), "error"))))
    return kept.agg(
        whole("n", 0).alias("samples"), *(F.round(whole(c, 0.0), 9).alias(name) for c, name in (("score", "score"), ("exact", "exact_rate"), ("valid", "valid_rate"))),
        F.array_join(F.transform(told, lambda x: F.concat_ws(":", x["error"], -x["m"])), ",").alias("top_errors"),
    )


def rollout_summary(df: DataFrame, group: list[str], slot: str, valid: str, caption: str, progress: str, expected: DataFrame | None = None) -> DataFrame:
    """(group, slots, generated, coverage, valid_rate, mean_caption, mae): runs by group; invalid rows score 0 and are off by 100, slots without a row count against the coverage.

    expected has group and slot; without it the slots are those that have a row.
    """
    own = df.select(*group, slot, F.coalesce(F.col(valid), F.lit(False)).alias("__v"), F.col(caption).alias("__c"), F.abs(progress).alias("__p"))
    sums = own.groupBy(*group).agg(
        F.count_distinct(slot).alias("generated"), F.round(F.avg(F.col("__v").cast("int")), 9).alias("valid_rate"), F.round(F.avg(F.when(F.col("__v"), F.coalesce("__c", F.lit(0.0))).otherwise(0.0)), 9).alias("mean_caption"),
        F.round(F.avg(F.when(F.col("__v"), F.coalesce("__p", F.lit(100))).otherwise(100)), 9).alias("mae"),
    )
    wanted = (own if expected is None else expected).groupBy(*group).agg(F.count_distinct(slot).alias("slots"))
    out = wanted.join(sums, group, "left").withColumn("generated", F.coalesce("generated", F.lit(0)))
    return out.select(*group, "slots", "generated", F.round(F.col("generated") / F.col("slots"), 9).alias("coverage"), "valid_rate", "mean_caption", "mae")


def paired_rollouts(df: DataFrame, key: list[str], variant: str, baseline: str, value: str) -> DataFrame:
    """(variant, pairs, mean_delta, better, worse) of each variant against the baseline on the same keys."""
    base = df.where(F.col(variant) == baseline).groupBy(*key).agg(F.min(value).alias("__base"))
    both = df.where(F.col(variant) != baseline).join(base, key).withColumn("d", F.col(value) - F.col("__base"))
    return both.groupBy(variant).agg(F.count("d").alias("pairs"), F.round(F.avg("d"), 9).alias("mean_delta"), F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"))


def scan_statistics(df: DataFrame, source: str, status: str, samples: str, error: str, retryable: str) -> DataFrame:
    """(section, source, name, n): episodes by source and status, samples by source, failures by error and those that may be tried again."""
    own = df.select(F.col(source).alias("source"), F.col(status).alias("status"), F.coalesce(F.col(samples), F.lit(0)).cast("long").alias("samples"), F.coalesce(F.col(error), F.lit("unknown_error")).alias("error"), F.coalesce(F.col(retryable), F.lit(False)).alias("again"))
    failed = F.col("status") == "failed"
    row = lambda section, source, name, n: F.struct(F.lit(section).alias("section"), source.alias("source"), name.alias("name"), n.cast("long").alias("n"))
    none, one = F.lit(""), F.lit(1)
    every = [row("status", F.col("source"), F.col("status"), one), row("samples", F.col("source"), F.lit("samples"), F.col("samples")), F.when(failed, row("error", none, F.col("error"), one)), F.when(failed & F.col("again"), row("retryable", none, F.lit("retryable"), one))]
    parts = F.array_compact(F.array(*every))
    return own.select(F.explode(parts).alias("p")).select("p.*").groupBy("section", "source", "name").agg(F.sum("n").alias("n"))


def review_picks(df: DataFrame, source: str, key: str, order: list[Column], second: list[Column]) -> DataFrame:
    """(source, key, role): of each source the first row by one order, and of the others the first by another; the first one again if there are no others."""
    own = df.withColumns({"__a": F.struct(*order, key), "__b": F.struct(*second, key)})
    first = own.groupBy(source).agg(F.min_by(key, "__a").alias("__first"))
    rest = own.join(first, source)
    last = rest.groupBy(source).agg(F.min_by(key, F.when(F.col(key) != F.col("__first"), F.col("__b"))).alias("__last"))
    both = first.join(last, source).select(source, F.explode(F.array(F.struct(F.lit("transition").alias("role"), F.col("__first").alias(key)), F.struct(F.lit("terminal").alias("role"), F.coalesce("__last", "__first").alias(key)))).alias("x"))
    return both.select(source, f"x.{key}", "x.role")


def evenly_spaced(df: DataFrame, order: list[str], wanted: int) -> DataFrame:
    """The rows at floor(i (n - 1) / (wanted - 1)) of the order, i from 0; all of a table that has no more. At least two have to be wanted."""
    if wanted < 2:
        raise ValueError("at least two rows have to be wanted")
    ranked, n = global_rank(df, order)
    if n <= wanted:
        return ranked.drop("rank")
    # a row is picked if some i has its place: the least i that isn't below it
    i = F.floor((F.col("rank") * (wanted - 1) + n - 2) / (n - 1))
    return ranked.where(F.floor(i * (n - 1) / (wanted - 1)) == F.col("rank")).drop("rank")


def seeded_sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """The k rows whose keys have the least seeded hash; each task keeps k."""
    return df.withColumn("__score", F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")), 256)).orderBy("__score", key).limit(k).drop("__score")


def prompt_leaks(df: DataFrame, text: str, group: list[str], forbidden: list[str]) -> DataFrame:
    """(group, prompts, leaks): how many prompts there are, and how many hold a text that they mustn't."""
    held = F.coalesce(F.exists(F.array(*map(F.lit, forbidden)), lambda x: F.contains(F.col(text), x)), F.lit(False))
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("prompts"), F.count_if(held).alias("leaks"))


def paired_allocation(leaves: DataFrame, name: str, pair: str, side: str, size: str, total: int, whole: bool) -> DataFrame:
    """leaves and ``share``: every leaf its minimum (its size if whole, else one), the rest in units of two, a pair getting one on each side.

    Rows with a pair come as two of the same size; others are alone and get both of a
    unit. An odd rest first gives one to the largest leaf that is alone, ties to the last
    name; units go by the largest remainder of the sizes, ties to the last name.
    """
    least = F.col(size) if whole else F.lit(1).cast("long")
    unit = F.coalesce(F.concat(F.lit("p"), F.col(pair).cast("string")), F.concat(F.lit("s"), F.col(name).cast("string")))
    own = leaves.withColumns({"__least": least.cast("long"), "__unit": unit})
    sums = own.agg(F.sum("__least"), F.max_by(name, F.when(F.col(pair).isNull(), F.struct(size, name)))).first()  # two values
    rest = total - (sums[0] or 0)
    if rest < 0:
        raise ValueError("the total is less than the sum of the minimums")
    if rest % 2 and sums[1] is None:
        raise ValueError("an odd rest needs a leaf that is alone")
    units = own.groupBy("__unit").agg(F.max(size).alias("__w"), F.max(F.col(name).cast("string")).alias("__n"), F.count(F.lit(1)).alias("__k"))
    broken = units.where("(__unit like 'p%') <> (__k = 2)").limit(1).count()
    if broken:
        raise ValueError("a pair has to have two sides")
    two = rest // 2
    weight = units.agg(F.sum("__w")).first()[0] or 1
    floor = F.expr(f"cast(__w as bigint) * {two}L div {weight}L")
    ranked, _ = global_rank(units.withColumns({"__floor": floor, "__rest": -F.pmod(F.col("__w").cast("long") * two, F.lit(weight))}), ["__rest", "__n"])
    left = two - (units.agg(F.sum(floor)).first()[0] or 0)
    # ties of a remainder go to the last name: places are turned round within it
    ties = ranked.groupBy("__rest").agg(F.min("rank").alias("__low"), F.max("rank").alias("__high"))
    placed = ranked.join(ties, "__rest").withColumn("__place", F.col("__low") + F.col("__high") - F.col("rank"))
    given = placed.select("__unit", (F.col("__floor") + (F.col("__place") < left).cast("long")).alias("__given"))
    odd = F.lit(rest % 2) * F.coalesce((F.col(pair).isNull() & (F.col(name) == F.lit(sums[1]))).cast("int"), F.lit(0))
    out = own.join(given, "__unit").withColumn("share", F.col("__least") + F.when(F.col(pair).isNull(), 2 * F.col("__given")).otherwise(F.col("__given")) + odd)
    return out.select(*leaves.columns, "share")
