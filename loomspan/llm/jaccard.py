"""Exact n-gram Jaccard join: size-aware, heavy and light sets.

A document's set is its distinct shingles of k words; two documents link when the
Jaccard similarity of their sets reaches num / den. Documents of equal sets form a
class, and everything below works on one member of each.

- Light sets (size up to a boundary) meet by enumerated subsets: two sets that link
  share a subset of the overlap that their sizes ask for, so each emits the keys of all
  its subsets of those fixed sizes.
- Heavy sets scan inverted lists: shingles are ordered from rare to frequent, and two
  sets that link share one of the first n - ceil(n * num / den) + 1. Light sets large
  enough to link with a heavy one are in the lists too.
- The boundary is where enumeration plus scanning costs least, from the sizes counted.

Rarity is that of a shingle's rarest word, then that of all its words together, by a
table of word counts with a fixed number of buckets, over the whole corpus; the order
needs only to be the same for all sets.

Lists of the same sets count once. Sets meet in groups of at most about SIDE sets or
GROUP_SHINGLES shingles: a longer list is dealt into blocks, and each pair of blocks is a
group. A group is first thinned out by its sets' first shingles alone: two that link share
a number of them that their sizes tell. Sets connected by such plausible pairs are a
family, and only sets of a family are compared by whole sets: a family of up to FAMILY sets
in groups of its own, so each set is sent once for every SIDE sets of its family; a
larger one in the groups of its lists, of which those of the same sets count once. All
plausible pairs meet either way, so no link between different texts is lost. Overlaps
are products of 0/1 matrices, and a group gives back a forest of its links, so no row is
ever made for a pair.

The whole sets of all that have a plausible partner are made from the texts once, found by a bitmap
of fixed size and joined exactly.

Defined results: null texts, and those without words, have the empty set and are their
own component; fewer than k words are one shingle, the whole sequence. Rows of one id
are rows of their own. An id that is null has its row in a component whose smallest id
counts only real ids. Further columns are ignored by ``join`` and kept by
``keep_one``, which keeps rows with a null id as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import Scratch, fresh, settle, table

WORD_BITS = 20
#: Sizes that may count as light; their sets are kept whole for enumeration.
MOST_LIGHT = 32
BITMAP_BITS = 24
#: Sets, and shingles in all, of a group that is compared in one task (one set may be larger).
SIDE, GROUP_SHINGLES = 1024, 1 << 20
#: A family of more sets is compared list by list.
FAMILY = 4096
_RANK = tb.U64(56)


def word_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For each bucket of word hashes, 8 * log2(1 + occurrences) in one byte, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << WORD_BITS, np.int64)
        for batch in batches:
            for _, _, data, bounds in tb.chunks(batch.column(0)):
                h, _ = tb.words(data, bounds)
                total += np.bincount((h >> tb.U64(64 - WORD_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    sums = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tb.tidy(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.select("bucket", F.least(F.rint(8 * F.log2(F.col("n") + 1)), F.lit(255.0)).cast("short").alias("rank")).toArrow()  # at most 2 ** WORD_BITS rows
    out = np.zeros(1 << WORD_BITS, np.uint8)
    out[found.column("bucket").to_numpy()] = found.column("rank").to_numpy()
    return out


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int, ranks: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, from rare to frequent: the rarest word's rank in the upper byte, the mean rank in the next, 48 bits of hash below."""
    h, row = tb.words(data, bounds)
    n = len(bounds) - 1
    at = tb.row_starts(row, n)
    rarity = ranks[(h >> tb.U64(64 - WORD_BITS)).astype(np.int64)]
    count = max(0, len(h) - k + 1)
    acc, low, mean = np.zeros(count, tb.U64), np.full(count, 255, np.uint8), np.zeros(count, tb.U64)
    factor = tb.U64(1)
    for j in range(k):
        acc += h[j : j + count] * factor
        np.minimum(low, rarity[j : j + count], out=low)
        mean += rarity[j : j + count]
        factor = tb.U64((int(factor) * 0xD6E8FEB86659FD93) & (2**64 - 1))
    ids = (low.astype(tb.U64) << _RANK) | (mean // tb.U64(k) << tb.U64(48)) | (tb.mix(acc) >> tb.U64(16))
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            yield np.unique(ids[a : b - k + 1])
        elif b > a:
            part, factor = tb.U64(b - a), tb.U64(1)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    part += x * factor
                    factor *= tb.U64(0xD6E8FEB86659FD93)
            yield (tb.U64(int(rarity[a:b].min())) << _RANK) | (tb.mix(np.array([part ^ tb.U64(0xABCDEF)])) >> tb.U64(16))
        else:
            yield np.zeros(0, tb.U64)


def least_overlap(n: int, m: int, num: int, den: int) -> int:
    """The overlap that sets of sizes n and m need to link: ceil(num (n + m) / (num + den))."""
    return -(-num * (n + m) // (num + den))


def subset_sizes(n: int, boundary: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets that a set of size n shares with a light partner."""
    partners = range(-(-num * n // den), min(boundary, den * n // num) + 1)
    return sorted({least_overlap(n, m, num, den) for m in partners})


def choose_boundary(sizes: dict[int, tuple[int, float]], num: int, den: int) -> int:
    """sizes: for each size up to MOST_LIGHT, sets and mean cost of scanning its lists. The boundary of least cost."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, (sets, scan) in sizes.items():
            if n <= boundary:
                total += sets * sum(comb(n, size) for size in subset_sizes(n, boundary, num, den))
            if n > boundary or den * n >= num * (boundary + 1):
                total += sets * scan
        return total

    return min(range(MOST_LIGHT + 1), key=cost)


def subset_keys(ids: np.ndarray, boundary: int, num: int, den: int) -> np.ndarray:
    """Keys of all subsets of the wanted sizes: sums of the members' mixed ids, with the size."""
    mixed = tb.mix(ids.copy())
    total, n = mixed.sum(dtype=tb.U64), len(ids)
    keys = []
    for size in subset_sizes(n, boundary, num, den):
        drop = n - size
        gone = np.zeros(1, tb.U64) if not drop else mixed[np.array(list(combinations(range(n), drop)))].sum(axis=1, dtype=tb.U64)
        keys.append(tb.mix(total - gone + tb.U64(size * 0x1F123BB5)))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, tb.U64)


def sets(docs: DataFrame, shared: Broadcast, k: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, cls, cost, prefix, small): size, class (a hash of the whole set), estimated cost of its lists, first shingles, and the whole set where it is small."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in tb.chunks(batch.column(1)):
                size, cls, cost, prefix, small = [], [], [], [], []
                for ids in shingle_sets(data, bounds, k, shared.value):
                    n = len(ids)
                    head = ids[: n - -(-num * n // den) + 1] if n else ids
                    size.append(n)
                    cls.append(set_class(ids))
                    cost.append(float(np.exp2((head >> _RANK).astype(np.float64) / 8).sum()))
                    prefix.append(head.view(np.int64))
                    small.append(ids.view(np.int64) if n <= MOST_LIGHT else ids[:0].view(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(size, pa.int32()), pa.array(cls, pa.int64()), pa.array(cost, pa.float64()), pa.array(prefix, longs), pa.array(small, longs)],
                    names=["doc_id", "n", "cls", "cost", "prefix", "small"],
                )

    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return ids.mapInArrow(tb.tidy(rows), "doc_id long, n int, cls long, cost double, prefix array<long>, small array<long>")


def set_class(ids: np.ndarray) -> int:
    """A 64-bit hash of the whole set."""
    a = tb.mix(ids.copy()).sum(dtype=tb.U64)
    b = tb.mix(ids ^ tb.U64(0x94D049BB133111EB)).sum(dtype=tb.U64)
    return int(tb.mix(np.array([a ^ tb.mix(np.array([b + tb.U64(len(ids))]))[0]]))[0].view(np.int64))


def bitmap(column: Column, rows: DataFrame) -> np.ndarray:
    """Map of the highest bits of a column of hashes, packed; its size is fixed."""
    slot = F.shiftrightunsigned(column, 64 - BITMAP_BITS).cast("int")
    words = rows.select(slot.alias("slot")).distinct().groupBy(F.shiftright("slot", 12).alias("block")).agg(F.collect_list("slot").alias("slots")).toArrow()
    bits = np.zeros(1 << BITMAP_BITS, bool)
    if words.num_rows:
        bits[words.column("slots").combine_chunks().flatten().to_numpy()] = True
    return np.packbits(bits)


def lists(classes: DataFrame, boundary: int, num: int, den: int, only: Broadcast | None = None) -> DataFrame:
    """(key, cls, n, pos): entries of the inverted lists (pos: place in the set's order) and of the subsets (pos -1); ``only``: those whose key may be in a map."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = None if only is None else np.unpackbits(only.value).view(bool)
        for batch in batches:
            key, cls, size, pos = [], [], [], []

            def add(c: int, n: int, own: np.ndarray, at: np.ndarray) -> None:
                if has is not None:
                    keep = has[(own.view(tb.U64) >> tb.U64(64 - BITMAP_BITS)).astype(np.int64)]
                    own, at = own[keep], at[keep]
                key.append(own)
                pos.append(at)
                cls.append(np.full(len(own), c))
                size.append(np.full(len(own), n, np.int32))

            for c, n, prefix, small in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if n <= boundary:
                    own = subset_keys(small.values.to_numpy().view(tb.U64), boundary, num, den).view(np.int64)
                    add(c, n, own, np.full(len(own), -1, np.int32))
                if n > boundary or den * n >= num * (boundary + 1):
                    own = prefix.values.to_numpy()
                    add(c, n, own, np.arange(len(own), dtype=np.int32))
            kinds = (np.int64, np.int64, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t)) for x, t in zip((key, cls, size, pos), kinds, strict=True)], names=["key", "cls", "n", "pos"])

    return classes.select("cls", "n", "prefix", "small").mapInArrow(tb.tidy(rows), "key long, cls long, n int, pos int")


def _up(x: Column, y: int) -> Column:
    """x / y of whole numbers, rounded up."""
    return F.floor((x + (y - 1)) / F.lit(float(y)) + 1e-9)


def whole_sets(docs: DataFrame, wanted: DataFrame, shared: Broadcast, k: int, text: str = "text") -> DataFrame:
    """(cls, ids) of each wanted class, made again from the texts, packed; ``shared``: the ranks and a map of the wanted classes. A task sends a class once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, packed = shared.value
        has = np.unpackbits(packed).view(bool)
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, bounds in tb.chunks(batch.column(0)):
                cls, whole = [], []
                for ids in shingle_sets(data, bounds, k, ranks):
                    if len(ids) and has[((c := set_class(ids)) & (2**64 - 1)) >> (64 - BITMAP_BITS)] and c not in seen:
                        if len(seen) < 1 << 18:
                            seen.add(c)
                        cls.append(c)
                        whole.append(tb.packed(np.diff(ids, prepend=tb.U64(0)), "<u8"))
                if cls:
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(whole, pa.binary())], names=["cls", "ids"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tb.tidy(rows), "cls long, ids binary")
    return found.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("ids").alias("ids"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, by products of 0/1 matrices over the shingles that two sets or more hold; a set's own place in one list with itself means nothing."""
    every = np.concatenate(left) if left is right else np.concatenate([*left, *right])
    ids, place, held = np.unique(every, return_inverse=True, return_counts=True)
    column = np.cumsum(held > 1) - 1
    sides, at = [], 0
    for group in (left,) if left is right else (left, right):
        size = np.array([len(x) for x in group])
        own = place[at : at + size.sum()]
        at += int(size.sum())
        keep = held[own] > 1
        row, col = np.repeat(np.arange(len(group)), size)[keep], column[own[keep]]
        by = np.argsort(col, kind="stable")
        sides.append((len(group), row[by], col[by]))
    out = np.zeros((len(left), len(right)), np.float32)  # exact: counts stay far below 2 ** 24
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        dense = []
        for n, row, col in sides:
            a, b = np.searchsorted(col, [low, low + width])
            m = np.zeros((n, width), np.float32)
            m[row[a:b], col[a:b] - low] = 1
            dense.append(m)
        out += dense[0] @ dense[-1].T
    return out


def forest(link: np.ndarray, one: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the left and right nodes of a bipartite graph, left node i being i and right node j being n + j; ``one``: both sides are the same nodes, and i stands for both."""
    n, m = link.shape
    left, right, far = np.arange(n), np.arange(m) + (0 if one else n), n + m
    while True:
        new_left = np.minimum(left, np.where(link, right[None, :], far).min(axis=1, initial=far))
        new_right = new_left if one else np.minimum(right, np.where(link, new_left[:, None], far).min(axis=0, initial=far))
        if np.array_equal(left, new_left) and np.array_equal(right, new_right):
            return left, right
        left, right = new_left, new_right


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of a group's left and right sets; both are all where a block meets itself."""
    side = rows.column("side").to_numpy()
    if rows.column("i")[0].as_py() == rows.column("j")[0].as_py():
        return np.arange(len(side)), np.arange(len(side))
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _halves(values: list, a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    left = [values[x] for x in a]
    return left, left if np.array_equal(a, b) else [values[x] for x in b]


def heads(classes: DataFrame) -> DataFrame:
    """(cls, head): 32 bits of each first shingle's hash, packed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = [tb.packed(np.diff(np.sort(x.values.to_numpy().astype(np.uint32)), prepend=np.uint32(0))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(head, pa.binary())], names=["cls", "head"])

    return classes.select("cls", "prefix").mapInArrow(tb.tidy(rows), "cls long, head binary")


def plausible(groups: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(key, i, j, label, side, cls, n, anchor): the groups' components of pairs whose sizes and first shingles allow a link; anchor is the least class of each."""

    def parts(rows: pa.Table) -> pa.Table:
        a, b = _sides(rows)
        ids = [np.cumsum(tb.unpacked(x), dtype=np.uint32) for x in rows.column("head").to_pylist()]
        n, cls = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "cls"))
        # equal bits of different shingles can only add to an overlap, but for those of one set
        twice = np.array([len(x) for x in ids])
        ids = [np.unique(x) for x in ids]
        twice -= np.array([len(x) for x in ids])
        shared = overlaps(*_halves(ids, a, b)).astype(np.int64)
        na, nb = n[a][:, None], n[b][None, :]
        behind = np.maximum(-(-n * num // den)[a][:, None], -(-n * num // den)[b][None, :])
        least = -(-(na + nb) * num // (num + den)) - behind + 1 - twice[a][:, None] - twice[b][None, :]
        sized = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
        same = len(a) == len(rows)
        la, lb = forest(sized & (shared >= least) & (cls[a][:, None] != cls[b][None, :]), same)
        label, place = (la, a) if same else (np.concatenate([la, lb]), np.concatenate([a, b]))
        tb.release()
        _, inverse, size = np.unique(label, return_inverse=True, return_counts=True)
        anchor = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(anchor, inverse, cls[place])
        keep = size[inverse] > 1
        kept = rows.take(pa.array(place[keep]))
        return pa.table({**{c: kept.column(c) for c in ("key", "i", "j")}, "label": pa.array(label[keep].astype(np.int32)), **{c: kept.column(c) for c in ("side", "cls", "n")}, "anchor": pa.array(anchor[inverse[keep]])})

    dealt = groups.join(heads(classes), "cls").select("key", "i", "j", "side", "cls", "n", "head")
    return dealt.groupBy("key", "i", "j").applyInArrow(parts, "key long, i int, j int, label int, side int, cls long, n int, anchor long")


def compared(groups: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), pairs of one component each, of the groups (key, i, j, label, side, cls) compared by whole sets."""

    def links(rows: pa.Table) -> pa.Table:
        a, b = _sides(rows)
        if len(a) == 0 or len(b) == 0 or len(rows) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        cls = rows.column("cls").to_numpy()
        ids = [np.cumsum(tb.unpacked(x, "<u8"), dtype=tb.U64) for x in rows.column("ids").to_pylist()]
        shared = overlaps(*_halves(ids, a, b)).astype(np.int64)
        size = np.array([len(x) for x in ids])
        la, lb = forest(shared * den >= (size[a][:, None] + size[b][None, :] - shared) * num, len(a) == len(rows))
        every = np.concatenate([cls[a], cls[b]])
        one, other = every, every[np.concatenate([la, lb])]
        apart = one != other
        tb.release()
        return pa.table({"a": one[apart], "b": other[apart]})

    dealt = groups.join(whole, "cls").select("key", "i", "j", "label", "side", "cls", "ids")
    return dealt.groupBy("key", "i", "j", "label").applyInArrow(links, "a long, b long").distinct()


def dealt_in_blocks(entries: DataFrame) -> DataFrame:
    """(key, i, j, side, cls, n): the sets of each list in groups of bounded size, one for each pair of blocks."""
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.col("n").cast("long")).alias("shingles"))
    blocks = F.greatest(_up(F.col("sets"), SIDE), _up(F.col("shingles"), GROUP_SHINGLES)).cast("int")
    own = entries.select("key", "cls", "n").join(sizes.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "n")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, root): the smallest class of each class's component, by the least label of neighbours and jumps to labels' labels."""
    both = scratch.settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = scratch.settle(both.groupBy(F.col("a").alias("cls")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = both.join(label.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("root").alias("near"))
        lower = label.join(near, "cls").select("cls", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = label.select(F.col("cls").alias("root"), F.col("root").alias("further"))
        new = scratch.settle(lower.join(jump, "root", "left").select("cls", F.least("root", F.coalesce("further", "root")).alias("root"), "old"))
        changed = new.where("root <> old").limit(1).count()
        label = new.select("cls", "root")
        if not changed:
            return label


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        ranks = word_ranks(narrow)
        every = scratch.settle(sets(narrow, scratch.broadcast(ranks), k, num, den))
        # the members of a class have equal columns, so any one stands for it
        classes = scratch.settle(every.where("n > 0").groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n", "cost", "prefix", "small"))))
        sizes = {r["n"]: (r["sets"], r["cost"]) for r in classes.where(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("sets"), F.avg("cost").alias("cost")).collect()}
        boundary = choose_boundary(sizes, num, den)
        # lists of two sets or more; those of the same sets have the same count and the same two sums of hashes
        prints = [F.bit_xor(F.xxhash64("cls", F.lit(x))).alias(f"print{x}") for x in (0, 1)]
        counts = scratch.settle(lists(classes, boundary, num, den).groupBy("key").agg(F.count(F.lit(1)).alias("sets"), *prints).where("sets > 1"))
        some = scratch.broadcast(bitmap(F.col("key"), counts))
        once = counts.groupBy("sets", "print0", "print1").agg(F.min("key").alias("key")).select("key")
        entries = scratch.settle(lists(classes, boundary, num, den, some).join(once, "key").select("key", "cls", "n"))
        groups = scratch.settle(plausible(dealt_in_blocks(entries), classes, num, den))
        tied = groups.where("cls <> anchor").select(F.col("cls").alias("a"), F.col("anchor").alias("b")).distinct()
        family = components(tied, scratch).withColumnRenamed("root", "family")
        large = scratch.settle(family.groupBy("family").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > FAMILY).select("family"))
        member = groups.select("cls", "n").distinct().join(family, "cls")
        small = dealt_in_blocks(member.join(large, "family", "left_anti").select(F.col("family").alias("key"), "cls", "n")).withColumn("label", F.lit(-1))
        listed = groups.join(member.join(large, "family", "left_semi").select("cls"), "cls", "left_semi")
        shape = listed.groupBy("key", "i", "j", "label").agg(F.count(F.lit(1)).alias("sets"), *(F.bit_xor(F.xxhash64("cls", "side", F.lit(x))).alias(f"print{x}") for x in (0, 1))).withColumn("square", F.col("i") == F.col("j"))
        first = shape.groupBy("sets", "print0", "print1", "square").agg(F.min(F.struct("key", "i", "j", "label")).alias("x")).select("x.*")
        columns = ("key", "i", "j", "label", "side", "cls")
        met = small.select(*columns).unionByName(listed.join(first, ["key", "i", "j", "label"], "left_semi").select(*columns))
        wanted = groups.select("cls").distinct()
        shared = scratch.broadcast((ranks, bitmap(F.col("cls"), wanted)))
        edges = scratch.settle(compared(met, whole_sets(narrow, wanted, shared, k), num, den))
        roots = components(edges, scratch)
        member = every.select("doc_id", "n", "cls").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        least = member.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
        return settle(member.join(least, "root", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id; rows are told apart by number, as an id may have several texts.

    Of texts without shingles, equal ones of an id count as one. Rows without id all stay.
    """
    row = fresh("__row", docs.columns)
    held = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = join(held, k, num, den, row, text).select(F.col("doc_id").alias("__row"), F.col("n_shingles").alias("__n"), F.col("component_id").alias("__component"))
    alone = held.select(F.col(row).alias("__row"), F.col(doc_id).cast("long").alias("__id"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("__print")).where(F.col("__id").isNotNull())
    own = F.col("__n") == 0
    group = [F.when(~own, F.col("__component")).alias("__c"), F.when(own, F.col("__id")).alias("__i"), F.when(own, F.col("__print")).alias("__p")]
    kept = groups.join(alone, "__row").groupBy(*group).agg(F.min_by("__row", F.struct("__id", "__row")).alias("__row")).select("__row")
    return held.where(F.col(doc_id).isNotNull()).join(kept.withColumnRenamed("__row", row), row, "left_semi").unionByName(held.where(F.col(doc_id).isNull())).select(*docs.columns)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 3-word shingles and a Jaccard similarity of 0.9."""
    return join(table(spark, sf_dir, "documents"), 3, 90, 100)
