"""Packing of items into bins, in shards of a bounded number of items.

A bin begins with the largest item left and takes the largest that still fits until none
does. Bins never cross shards, so each shard is one task's work; a shard wastes at most
its last bins, whatever the table's size.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bins(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length, given longest first; equal ones go in the order given. An item over the capacity has a bin of its own."""
    sizes = sorted(set(lengths))
    left: dict[int, list[int]] = {n: [] for n in sizes}
    for i in range(len(lengths) - 1, -1, -1):
        left[lengths[i]].append(i)
    # below[k + 1] leads to the greatest size up to sizes[k] that has items left, 0 to none
    below = list(range(len(sizes) + 1))

    def greatest(k: int) -> int:
        root = k
        while below[root] != root:
            root = below[root]
        while below[k] != root:
            below[k], k = root, below[k]
        return root

    where, bins = [0] * len(lengths), 0
    while k := greatest(len(sizes)):
        room = max(capacity, sizes[k - 1])
        while k:
            n = sizes[k - 1]
            where[left[n].pop()] = bins
            room -= n
            if not left[n]:
                below[k] = k - 1
            k = greatest(bisect_right(sizes, room if n <= capacity else -1))
        bins += 1
    return where


def best_fit_bins(items: DataFrame, item: str, length: str, capacity: int, shard_rows: int = 50_000) -> DataFrame:
    """(item, length, shard, bin) of every item of 0 or more; others, and nulls, can't be estimated and are left out."""
    clean = items.where(F.col(length) >= 0).select(F.col(item).alias("item"), F.col(length).cast("long").alias("length"))
    shards = max(1, -(-clean.count() // shard_rows))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "item"], ascending=[False, True], kind="stable")
        return frame.assign(bin=_bins(frame["length"].tolist(), capacity))

    return clean.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(one, "item long, length long, shard int, bin long")
