"""A split that keeps every class on both sides and follows the shares of classes, tasks and sizes.

One item after the other goes to the test side: of those that leave each of their classes
something to train on, the one whose classes, task and size lack most there. Items with
the same classes, task and size lack the same, so the choice is made among such kinds:
their counts are few and come to the driver, and the order of items within a kind is
that of a hash, which Spark ranks. Nothing of an item is sent to the driver but, of each
kind, the hashes of the items that can be next.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most kinds and, of all kinds together, most items that are chosen from.
KINDS, ITEMS = 100_000, 2_000_000


def _targets(totals: Counter, share: float) -> dict:
    return {c: min(n - 1, max(1, round(n * share))) for c, n in totals.items()}


def choose(kinds: list[tuple], size: int, cases: int, share: float) -> list[int]:
    """How many of each kind go to the test side. kinds: (classes, task, bin, cases of an item, hashes of its items, falling).

    Equal gains go by the hash of the kind's next item, as if items were compared one by one.
    """
    classes: Counter = Counter()
    tasks: Counter = Counter()
    bins: Counter = Counter()
    for own, task, bin_, _, hashes in kinds:
        for c in own:
            classes[c] += len(hashes)
        tasks[task] += len(hashes)
        bins[bin_] += len(hashes)
    want = _targets(classes, share)
    want_task = {t: round(n * share) for t, n in tasks.items() if n >= 5}
    want_bin = {b: round(n * share) for b, n in bins.items()}
    want_cases = round(cases * share)
    names, tasks_of, bins_of = (sorted(x) for x in (classes, tasks, bins))
    member = np.array([[c in own for c in names] for own, *_ in kinds])
    whole = np.array([classes[c] for c in names], np.float64)
    goal = np.array([want[c] for c in names], np.float64)
    task_at, bin_at = np.array([tasks_of.index(k[1]) for k in kinds]), np.array([bins_of.index(k[2]) for k in kinds])
    task_n, bin_n = np.array([tasks[t] for t in tasks_of], np.float64), np.array([bins[b] for b in bins_of], np.float64)
    task_goal, bin_goal = np.array([want_task.get(t, 0) for t in tasks_of], np.float64), np.array([want_bin[b] for b in bins_of], np.float64)
    taken, now, now_task, now_bin, now_cases = np.zeros(len(kinds), np.int64), np.zeros(len(names)), np.zeros(len(tasks_of)), np.zeros(len(bins_of)), 0
    left, following = np.array([len(h) for *_, h in kinds]), np.array([h[0] for *_, h in kinds])
    for _ in range(size):
        need = np.maximum(0, goal - now) / whole
        gain = np.zeros(len(kinds))
        for j in range(len(names)):  # class by class, as sums of fractions differ by their order
            gain += np.where(member[:, j], need[j], 0.0)
        gain = gain * 100 + (np.maximum(0, task_goal - now_task) / task_n)[task_at] * 8 + (np.maximum(0, bin_goal - now_bin) / bin_n)[bin_at] * 5 + max(0, want_cases - now_cases) / max(cases, 1)
        able = (left > 0) & ~(member & (now + 1 >= whole)).any(axis=1)
        if not able.any():
            raise ValueError("the test side can't be filled without taking all of a class")
        best = able & (gain == gain[able].max())
        k = int(np.flatnonzero(best)[np.argmax(following[best])])
        taken[k] += 1
        left[k] -= 1
        following[k] = kinds[k][4][taken[k]] if left[k] else -1
        now += member[k]
        now_task[task_at[k]] += 1
        now_bin[bin_at[k]] += 1
        now_cases += kinds[k][3]
    return taken.tolist()


def stratified_split(items: DataFrame, key: str, classes: str, task: str, size_bin: str, cases: str, share: float = 0.2, seed: int = 827) -> DataFrame:
    """items and ``test``: the share of them on the test side, every class on both.

    classes is an array of distinct names with one or more; an item of no class is left
    out. A class that has one item alone is an error, as is a share that isn't between 0
    and 1. Equal hashes go by key.
    """
    if not 0 < share < 1:
        raise ValueError("share has to be between 0 and 1")
    kind = F.struct(F.array_sort(classes).alias("classes"), F.coalesce(F.col(task).cast("string"), F.lit("")).alias("task"), F.coalesce(F.col(size_bin).cast("string"), F.lit("")).alias("bin"), F.coalesce(F.col(cases).cast("long"), F.lit(0)).alias("cases"))
    # 53 bits of the hash, as a share of one
    digest = F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")), 256)
    own = items.where(F.size(classes) > 0).withColumns({"__kind": kind, "__hash": F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")})
    counts = own.groupBy("__kind").agg(F.count(F.lit(1)).alias("n")).limit(KINDS + 1).collect()
    total = sum(r["n"] for r in counts)
    if len(counts) > KINDS or total > ITEMS:
        raise ValueError("too many kinds or items for one split; split them by a coarser task or in parts")
    if not total:
        return items.where(F.lit(False)).withColumn("test", F.lit(False))
    totals: Counter = Counter()
    for r in counts:
        totals.update({c: r["n"] for c in r["__kind"]["classes"]})
    if scarce := sorted(c for c, n in totals.items() if n < 2):
        raise ValueError(f"classes with one item: {scarce}")
    size = max(1, round(total * share))
    by_hash = Window.partitionBy("__kind").orderBy(F.desc("__hash"), F.desc(key))
    ranked = own.withColumn("__nth", F.row_number().over(by_hash))
    held = ranked.where(F.col("__nth") <= size).groupBy("__kind").agg(F.sort_array(F.collect_list("__hash"), False).alias("h")).collect()
    hashes = {tuple(map(str, r["__kind"])): r["h"] for r in held}
    kinds, rows = [], []
    for r in counts:
        k = r["__kind"]
        own_hashes = hashes[tuple(map(str, k))]
        kinds.append((tuple(k["classes"]), k["task"], k["bin"], k["cases"], own_hashes + [-1] * (r["n"] - len(own_hashes))))
        rows.append(k)
    taken = choose(kinds, size, sum(k["cases"] * r["n"] for k, r in zip(rows, counts, strict=True)), share)
    chosen = items.sparkSession.createDataFrame([(tuple(k), n) for k, n in zip(rows, taken, strict=True)], "k struct<classes:array<string>,task:string,bin:string,cases:bigint>, most long")
    return ranked.join(F.broadcast(chosen), ranked["__kind"] == chosen["k"]).withColumn("test", F.col("__nth") <= F.col("most")).select(*items.columns, "test")
