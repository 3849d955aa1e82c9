"""Ranked lexical search over an index that graph bisection puts in order.

Building: recursive graph bisection of a sample of documents and their terms (exchanges
between two halves that lower the cost of coding each term's documents) gives a tree of
splits with a weight for each term. Every document goes down that tree, term weights
adding up, so documents that share terms get the same cluster; the index holds every
row with all its terms and counts, in the order of clusters and of shards in them.

Searching: for each shard and item the greatest contribution of each term gives a bound
of any document's score. An item visits shards by falling bound, some at a time, and
stops when the next bound is below its k-th best score so far; equal bounds are still
visited, as the smaller doc_id wins ties. So the result is exact, whatever the order.

Terms are compared by 56 bits of hash: 10,000 query terms against a vocabulary of a
billion meet a false one with a chance below one in 5,000.

Defined results: null and empty texts have no terms, are in no statistic and match
nothing; items without terms give no rows. Repeated rows of documents or items are
ranked each; rows without id are behind all others of the same score. An empty table
gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import Scratch, drop_tables, settle, shared_folder, table

#: Documents from which the order is learned (up to twice as many), and buckets of their terms.
SAMPLE, BUCKETS = 2048, 1 << 14
DEPTH, EXCHANGES = 6, 10
#: Shards of a cluster, and parts in which a cluster's rows are dealt over tasks.
SHARDS, PARTS = 16, 64
#: Items of a block, and their terms together: what a pass over the index takes along.
ITEMS, TERMS = 1024, 1 << 20
#: Shards that an item visits first; then four times as many, and so on.
FIRST = 8
#: Documents that are scored at once.
ROWS = 1024
#: Cells of the matrix of terms that many items share.
MATRIX = 1 << 22
#: Fixed value: the factor to which term contributions are scaled.
SCALE = 1_000_000_000

_TERM = tb.LETTER.copy()
_TERM[48:58] = True


@dataclass
class Index:
    """The folder of an index and its statistics: documents with terms, and all their terms."""

    spark: SparkSession
    path: str
    documents: int
    terms: int

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        drop_tables(self.spark, [self.path])


def terms_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 56-bit hash and count of each row's distinct terms, by row and hash."""
    low = tb.LOWER[data]
    starts, ends, row = tb.runs(_TERM[data].astype(np.uint8), bounds)
    if not len(starts):
        return row, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = tb.Prefix(low).of(starts, ends) >> np.uint64(8)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])))
    return row[new], h[new], np.diff(np.append(new, len(h)))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(42)).astype(np.int64)


def bisection(rows: list[np.ndarray], depth: int = DEPTH, exchanges: int = EXCHANGES) -> np.ndarray:
    """Weights of terms at each inner node of the tree: a document goes right where they add up to more than 0."""
    weights = np.zeros((2**depth - 1, BUCKETS), np.float32)
    waiting = [(0, np.arange(len(rows)))]
    while waiting:
        node, docs = waiting.pop()
        if node >= len(weights) or len(docs) < 2:
            continue
        flat = np.concatenate([rows[d] for d in docs])
        owner = np.repeat(np.arange(len(docs)), [len(rows[d]) for d in docs])
        right = np.arange(len(docs)) >= len(docs) // 2
        n = np.array([len(docs) - right.sum(), right.sum()], np.float64)
        for _ in range(exchanges + 1):
            degree = [np.bincount(flat[right[owner] == side], minlength=BUCKETS).astype(np.float64) for side in (False, True)]
            cost = lambda a, b: a * np.log2(n[0] / (a + 1)) + b * np.log2(n[1] / (b + 1))
            now = cost(*degree)
            to_right = np.where(degree[0] > 0, now - cost(np.maximum(degree[0] - 1, 0), degree[1] + 1), 0)
            to_left = np.where(degree[1] > 0, now - cost(degree[0] + 1, np.maximum(degree[1] - 1, 0)), 0)
            gain = np.bincount(owner, np.where(right[owner], to_left[flat], to_right[flat]), len(docs))
            sides = [np.flatnonzero(right == side) for side in (False, True)]
            sides = [s[np.argsort(-gain[s], kind="stable")] for s in sides]
            m = min(map(len, sides))
            swaps = int(np.argmin(np.append(gain[sides[0][:m]] + gain[sides[1][:m]] > 0, False)))
            if not swaps:
                break
            right[sides[0][:swaps]], right[sides[1][:swaps]] = True, False
        degree = [np.bincount(flat[right[owner] == side], minlength=BUCKETS) for side in (False, True)]
        weights[node] = np.log2(n[0] / (degree[0] + 1)) - np.log2(n[1] / (degree[1] + 1))
        waiting += [(2 * node + 1, docs[~right]), (2 * node + 2, docs[right])]
    return weights


def cluster_of(row: np.ndarray, h: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """The leaf of the tree to which each of n rows goes."""
    node, at = np.zeros(n, np.int64), _bucket(h)
    while len(node) and node[0] < len(weights):
        total = np.bincount(row, weights[node[row], at], n)
        node = 2 * node + 1 + (total > 0)
    return node - len(weights)


def _sampled(docs: DataFrame, size: int) -> list[np.ndarray]:
    """Term buckets of some documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, last, data, bounds in tb.chunks(batch.column(0)):
                row, h, _ = terms_of(data, bounds)
                at = tb.row_starts(row, last - first)
                out += [np.unique(_bucket(h[a:b])).astype("<u2").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["b"])

    share = min(1.0, size / max(1, docs.count()))
    some = docs.sample(share, seed=17).limit(2 * size).mapInArrow(tb.tidy(rows), "b binary").toPandas()["b"]
    return [np.frombuffer(b, "<u2").astype(np.int64) for b in some if len(b)]


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, path: str | None = None) -> Index:
    """Index every row; the order is learned from up to 2 x sample of them."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with Scratch(spark) as scratch:
        tree = scratch.broadcast(bisection(_sampled(docs.select("text"), sample)))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, data, bounds in tb.chunks(batch.column(1)):
                    row, h, count = terms_of(data, bounds)
                    n = last - first
                    cluster = cluster_of(row, h, n, tree.value)
                    at = tb.row_starts(row, n)
                    seven = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()
                    small, large = np.minimum(count, 255).astype(np.uint8).tobytes(), count >= 255
                    more = count[large].astype("<u4").tobytes()
                    big = np.append(0, np.cumsum(large))[at]
                    cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, n),
                            pa.array(cluster, pa.int32()),
                            pa.array(tb.sum_rows(count, at), pa.int64()),
                            pa.array([seven[7 * a : 7 * b] for a, b in cuts], pa.binary()),
                            pa.array([small[a:b] for a, b in cuts], pa.binary()),
                            pa.array([more[4 * a : 4 * b] for a, b in zip(big[:-1].tolist(), big[1:].tolist(), strict=True)], pa.binary()),
                        ],
                        names=["doc_id", "cluster", "n", "terms", "counts", "more"],
                    )

        found = docs.mapInArrow(tb.tidy(rows), "doc_id long, cluster int, n long, terms binary, counts binary, more binary")
        # a cluster may hold most rows: its parts are dealt apart
        dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "n", "counts"), F.lit(PARTS)).cast("int"))
        dealt = dealt.withColumn("shard", F.col("cluster") * SHARDS + F.col("part") % SHARDS)
        dealt.repartition("cluster", "part").sortWithinPartitions("shard").drop("part", "cluster").write.parquet(path)
    seen = spark.read.parquet(path).where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    return Index(spark, path, seen[0], seen[1] or 0)


class _Block:
    """Items whose terms a task takes along: distinct terms, their weights, and the items of each."""

    def __init__(self, items: list[np.ndarray]):
        self.terms = np.unique(np.concatenate(items))
        self.n = len(items)
        term = np.searchsorted(self.terms, np.concatenate(items))
        item = np.repeat(np.arange(self.n), [len(x) for x in items])
        order = np.argsort(term, kind="stable")
        self.item, self.at = item[order], tb.row_starts(term[order], len(self.terms))
        # sums stay exact in doubles up to 2**53
        self.exact = max(map(len, items)) * 60_000 * (SCALE // 1000) < 1 << 53

    def weigh(self, found: np.ndarray, documents: int) -> None:
        """Weights by the number of documents that hold each term; terms of many items become a matrix."""
        self.weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * found + 1))).astype(np.int64)
        many = np.diff(self.at)
        self.common = np.argsort(-many, kind="stable")[: min(MATRIX >> 10, MATRIX // self.n)] if self.exact else np.zeros(0, np.int64)
        self.common = self.common[many[self.common] * 16 > self.n]
        self.column = np.full(len(self.terms), -1)
        self.column[self.common] = np.arange(len(self.common))
        self.matrix = np.zeros((len(self.common), self.n))
        spread = np.repeat(np.arange(len(self.common)), many[self.common])
        place = np.concatenate([np.arange(self.at[t], self.at[t + 1]) for t in self.common] or [np.zeros(0, np.int64)])
        self.matrix[spread, self.item[place]] = self.weight[self.common][spread]

    def scores(self, row: np.ndarray, term: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
        """Sums of weight x part for n rows by the block's items, as whole numbers."""
        at = self.column[term]
        dense = np.zeros((n, len(self.common)))
        dense[row[at >= 0], at[at >= 0]] = part[at >= 0]
        out = (dense @ self.matrix).astype(np.int64)
        row, term, part = row[at < 0], term[at < 0], part[at < 0]
        many = self.at[term + 1] - self.at[term]
        inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        item = self.item[np.repeat(self.at[term], many) + inside]
        np.add.at(out, (np.repeat(row, many), item), np.repeat(self.weight[term] * part, many))
        return out


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of bytes end to end, and the places where each row's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(data).view(kind), (offsets - offsets[0]) // width


def _hits(index: Index, terms) -> DataFrame:
    """(shard, doc_id, term, part): of documents with terms of the block, their places in it and what they add to a score without the weight."""
    documents, words = index.documents, index.terms

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.value
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                raw, at = _flat(batch.column(3), "u1")
                held, at = np.zeros((len(raw) // 7, 8), np.uint8), at // 7
                held[:, :7] = raw.reshape(-1, 7)
                h = held.view("<u8").reshape(-1)
                term = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                count = _flat(batch.column(4), "u1")[0].astype(np.int64)
                count[count == 255] = _flat(batch.column(5), "<u4")[0]
                row = np.repeat(np.arange(batch.num_rows), np.diff(at))
                hit = wanted[term] == h
                row, term, count = row[hit], term[hit], count[hit]
                m = 50 + 50 * np.asarray(batch.column(2)) * documents // words
                part = SCALE * count // (1000 * count + 20 * m[row])
                at = tb.row_starts(row, batch.num_rows)
                some = np.flatnonzero(at[1:] > at[:-1])
                a, b = term.astype("<u4").tobytes(), part.astype("<u4").tobytes()
                cuts = [(4 * at[k], 4 * at[k + 1]) for k in some]
                kept = [batch.column(c).take(pa.array(some)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([a[x:y] for x, y in cuts], pa.binary()), pa.array([b[x:y] for x, y in cuts], pa.binary())], names=["shard", "doc_id", "term", "part"])

    return index.rows().where("n > 0").select("shard", "doc_id", "n", "terms", "counts", "more").mapInArrow(tb.tidy(rows), "shard int, doc_id long, term binary, part binary")


def _held_by(hits: DataFrame, terms: int) -> np.ndarray:
    """The number of documents that hold each term of the block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0), "<u4")[0], minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["t", "df"])

    out = np.zeros(terms, np.int64)
    sums = hits.select("term").mapInArrow(tb.tidy(rows), "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).toPandas()
    out[sums["t"].to_numpy(np.int64)] = sums["df"].to_numpy(np.int64)
    return out


def _bounds(hits: DataFrame, shared, shards: int) -> np.ndarray:
    """The most that a document of each shard can score, shards by items."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, most = shared.value, None, None

        def bound() -> pa.RecordBatch:
            term = np.flatnonzero(most)
            total = block.scores(np.zeros(len(term), np.int64), term, most[term], 1)[0]
            item = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([held] * len(item), pa.int32()), pa.array(item, pa.int32()), pa.array(total[item], pa.int64())], names=["shard", "item", "bound"])

        for batch in batches:
            shard = np.asarray(batch.column(0))
            (term, at), part = _flat(batch.column(1), "<u4"), _flat(batch.column(2), "<u4")[0]
            ends = np.flatnonzero(np.append(shard[1:] != shard[:-1], True)) + 1 if len(shard) else []
            first = 0
            for end in ends:
                if shard[first] != held:
                    if held is not None:
                        yield bound()
                    held, most = int(shard[first]), np.zeros(len(block.terms), np.int64)
                np.maximum.at(most, term[at[first] : at[end]], part[at[first] : at[end]])
                first = end
        if held is not None:
            yield bound()

    found = hits.select("shard", "term", "part").mapInArrow(tb.tidy(rows), "shard int, item int, bound long").groupBy("shard", "item").agg(F.max("bound").alias("bound")).toPandas()
    out = np.zeros((shards, shared.value.n), np.int64)
    out[found["shard"].to_numpy(np.int64), found["item"].to_numpy(np.int64)] = found["bound"].to_numpy(np.int64)
    return out


def _best(item: np.ndarray, score: np.ndarray, missing: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each item."""
    order = np.lexsort((ids, missing, -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < k]


def _visited(hits: DataFrame, shared, plan, k: int) -> DataFrame:
    """The k best documents of each item in each task, of the shards that the plan has for it and not below its least score."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (visit, least) = shared.value, plan.value
        least = np.maximum(least, 1)
        held = [np.zeros(0, np.int64)] * 4
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                (term, at), part = _flat(batch.column(2), "<u4"), _flat(batch.column(3), "<u4")[0]
                row = np.repeat(np.arange(batch.num_rows), np.diff(at))
                score = block.scores(row, term.astype(np.int64), part.astype(np.int64), batch.num_rows)
                doc, item = np.nonzero((score >= least) & visit[np.asarray(batch.column(0))])
                ids, missing = np.asarray(batch.column(1).fill_null(0)), np.asarray(batch.column(1).is_null()).astype(np.int64)
                held = [np.concatenate(x) for x in zip(held, (item, score[doc, item], missing[doc], ids[doc]), strict=True)]
                if len(held[0]) > 4 * k * block.n:
                    best = _best(*held, k)
                    held = [x[best] for x in held]
                    full = np.flatnonzero(np.bincount(held[0], minlength=block.n) >= k)
                    low = np.full(block.n, 1 << 62)
                    np.minimum.at(low, held[0], held[1])
                    least[full] = np.maximum(least[full], low[full])
        best = _best(*held, k)
        item, score, missing, ids = (x[best] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=missing > 0), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return hits.mapInArrow(tb.tidy(rows), "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(index: Index, items: list[np.ndarray], k: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block; item counts from 0."""
    spark, shards = index.spark, 2**DEPTH * SHARDS
    block = _Block(items)
    with Scratch(spark) as scratch:
        hits = scratch.settle(_hits(index, scratch.broadcast(block.terms)))
        block.weigh(_held_by(hits, len(block.terms)), index.documents)
        shared = scratch.broadcast(block)
        bounds = _bounds(hits, shared, shards)
        order = np.argsort(-bounds, axis=0, kind="stable")
        falling = np.take_along_axis(bounds, order, axis=0)
        found, least, begin, step = None, np.zeros(block.n, np.int64), 0, FIRST
        while begin < shards:
            go = falling[begin : begin + step] >= np.maximum(least, 1)
            visit = np.zeros(bounds.shape, bool)
            visit[order[begin : begin + step][go], np.nonzero(go)[1]] = True
            some = np.flatnonzero(visit.any(axis=1))
            if not len(some):
                break
            part = scratch.settle(_visited(hits.where(F.col("shard").isin(some.tolist())), shared, scratch.broadcast((visit, least)), k))
            found = part if found is None else found.unionByName(part)
            begin, step = begin + step, 4 * step
            if begin < shards:
                last = _ranked(found, k).where(F.col("rank") == k).select("item", "score").toPandas()
                least[last["item"].to_numpy(np.int64)] = last["score"].to_numpy(np.int64)
        empty = spark.createDataFrame([], "item int, doc_id long, score long")
        return settle(_ranked(empty if found is None else found, k))


def _items(queries: DataFrame, item_id: str, text: str) -> DataFrame:
    """(row, item_id, terms, n): each item's distinct terms as 64-bit numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in tb.chunks(batch.column(1)):
                row, h, _ = terms_of(data, bounds)
                at, raw = tb.row_starts(row, last - first), h.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array(np.diff(at), pa.int64())], names=["item_id", "terms", "n"])

    found = queries.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).mapInArrow(tb.tidy(rows), "item_id long, terms binary, n long")
    return found.where("n > 0").withColumn("row", F.monotonically_increasing_id())


def search(index: Index, queries: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = index.spark
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    with Scratch(spark) as scratch:
        items = scratch.settle(_items(queries, item_id, text))
        count, terms = items.agg(F.count(F.lit(1)), F.sum("n")).first()
        blocks = max(-(-count // ITEMS), -(-(terms or 0) // TERMS))
        while blocks:
            held = items.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
            most = held.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).where((F.col("m") > 1) & ((F.col("m") > 2 * ITEMS) | (F.col("n") > 2 * TERMS)))
            if most.isEmpty():
                break
            blocks *= 2
        for b in range(blocks if index.terms else 0):
            # at most 2 x ITEMS rows and 2 x TERMS terms, or one item
            mine = held.where(F.col("block") == b).select("item_id", "terms").collect()
            if mine:
                best = _search_block(index, [np.frombuffer(r["terms"], "<u8") for r in mine], k)
                names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], "item int, item_id long")
                out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    index = build(table(spark, sf_dir, "documents"))
    out = search(index, table(spark, sf_dir, "benchmark"))
    index.drop()
    return out


#: The same by joins of all terms.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
held AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY ALL),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
terms AS (SELECT t, floor(1000 * ln((2 * any_value(w.docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM held, whole w WHERE t IN (SELECT t FROM asked) GROUP BY t),
scored AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * w.docs) // w.words)))))::BIGINT AS score
  FROM asked JOIN terms USING (t) JOIN held USING (t) JOIN docs USING (doc_id), whole w GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
