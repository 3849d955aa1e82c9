"""Toxicity: cumulative-link ordinal regression over sparse hashed text features.

Features are the words of a text (runs of letters, capitals folded) and their first 3 to 7
bytes, hashed to a fixed number of buckets, each worth log2(1 + count). One sparse
weight vector is shared by all thresholds: P(grade <= j) = sigmoid(t_j - w.x), with
t_1 < t_2 < t_3. The result is the expected grade, 0 (clean) to 3.

Labels only say toxic or not, so the order among toxic training texts comes from the
model itself, cross-fitted: with one threshold it learns without one fold of the sample
and scores that fold, and the thirds of these held-out scores are the grades 1 to 3 of the
toxic texts. The final fit then has all thresholds over the shared weights. Weights
come from proximal gradient steps (L1), so that few buckets have one and are broadcast.

The sample is bounded in texts (SAMPLE_PER_CLASS of either class) and in features
(MOST_FEATURES in all): whole texts in the order of their id hashes, as far as they fit, one
of each class at least. Training so costs the same at any corpus size and text length.

Defined results: null and empty texts, and every text where nothing could be learned
(no labels of both classes), have no features and get the grade of an empty text (0
without a model). Repeated rows get equal grades; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import Scratch, table
from .quality import labelled_sample, once

BITS = 20
GRADES = 3
FOLDS = 4
PREFIXES = (3, 4, 5, 6, 7)
#: At most so many labelled documents of either class are learned from; those of the lowest id hashes.
SAMPLE_PER_CLASS = 4000
#: Features (a bucket in a text) of all texts that are learned from together: 32 MB.
MOST_FEATURES = 1 << 22
L1 = 1.5e-3


def features(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and rows of the words, then of their prefixes of each length."""
    folded = tb.fold(data)
    starts, ends, row = tb.runs(tb.LETTER[data].astype(np.uint8), bounds)
    if not len(starts):
        return
    prefix = tb.Prefix(folded)
    shift = tb.U64(64 - BITS)
    yield (prefix.of(starts, ends) >> shift).astype(np.int64), row
    for n in PREFIXES:
        long = ends - starts > n
        yield (tb.mix(prefix.of(starts[long], starts[long] + n) + tb.U64(n)) >> shift).astype(np.int64), row[long]


class Model:
    """Buckets with a weight (sorted), their weights, and the thresholds."""

    def __init__(self, bucket: np.ndarray, weight: np.ndarray, thresholds: np.ndarray):
        self.thresholds = thresholds
        self.dense = np.zeros(1 << BITS, np.float32)
        self.dense[bucket] = weight

    def __getstate__(self):
        at = np.flatnonzero(self.dense)
        return self.thresholds, at, self.dense[at]

    def __setstate__(self, state):
        self.__init__(state[1], state[2], state[0])

    def levels(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. GRADES."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - linear[:, None], -40, 40)))

    def linear(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        keys = [np.zeros(0, np.int64)]
        for bucket, row in features(data, bounds):
            own = self.dense[bucket] != 0
            keys.append(row[own] << BITS | bucket[own])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        return np.bincount(key >> BITS, weights=self.dense[key & ((1 << BITS) - 1)] * np.log2(1 + count), minlength=n)


def _descend(doc: np.ndarray, at: np.ndarray, value: np.ndarray, grade: np.ndarray, features: int, levels: int, steps: int, l1: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model by proximal gradient steps over all texts."""
    n, k = len(grade), np.arange(len(grade))
    w, t = np.zeros(features), np.arange(levels) - 0.5
    rate, g_w, g_t = 0.25, np.full(features, 1e-8), np.full(levels, 1e-8)
    for _ in range(steps):
        p, per, gt = _gradient(np.bincount(doc, weights=w[at] * value, minlength=n), t, grade, k)
        gw = -np.bincount(at, weights=per[doc] * value, minlength=features)
        g_w += gw * gw
        g_t += gt * gt
        step = rate / np.sqrt(g_w)
        w -= step * gw
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1)
        t = np.sort(t - rate / np.sqrt(g_t) * gt)
        t = np.maximum.accumulate(t + np.arange(levels) * 1e-3)
    return w, t


def _gradient(linear: np.ndarray, t: np.ndarray, grade: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(grade >= j), and the slope of the mean negative log-likelihood by minus each text's linear score, and by each threshold."""
    n, levels = len(grade), len(t)
    p = 1 / (1 + np.exp(np.clip(t[None, :] - linear[:, None], -30, 30)))
    # likelihood of adjacent levels: grade j has p_j - p_(j+1)
    edge = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
    slope = np.hstack([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))])
    mass = np.maximum(edge[k, grade] - edge[k, grade + 1], 1e-9)
    d = np.zeros((n, levels + 2))
    d[k, grade] = slope[k, grade] / mass
    d[k, grade + 1] -= slope[k, grade + 1] / mass
    return p, d.sum(axis=1) / n, d[:, 1:-1].sum(axis=0) / n


def _grades(doc: np.ndarray, at: np.ndarray, value: np.ndarray, toxic: np.ndarray, features: int, l1: float) -> np.ndarray:
    """0 for clean texts; for toxic ones 1 to 3, by thirds of the scores that the model of the other folds gives them."""
    score, fold = np.zeros(len(toxic)), np.arange(len(toxic)) % FOLDS
    for k in range(FOLDS):
        learned = fold != k
        own = learned[doc]
        if len(set(toxic[learned])) == 2:
            place = np.cumsum(learned) - 1
            w, _ = _descend(place[doc[own]], at[own], value[own], toxic[learned].astype(np.int64), features, 1, 60, l1)
            score += np.where(learned, 0, np.bincount(doc, weights=w[at] * value, minlength=len(toxic)))
    grade = np.zeros(len(toxic), np.int64)
    grade[toxic] = 1 + np.searchsorted(np.quantile(score[toxic], [1 / 3, 2 / 3]), score[toxic], "left")
    return grade


def train(doc: np.ndarray, feature: np.ndarray, count: np.ndarray, toxic: np.ndarray, shift: float, steps: int = 250, l1: float = L1) -> Model:
    """doc, feature, count: the occurrences; shift: log of how much rarer toxic texts are than in this sample."""
    # a bucket in under three texts says nothing about others
    used = np.flatnonzero(np.bincount(feature, minlength=1 << BITS) >= 3)
    at = np.searchsorted(used, feature).clip(0, max(0, len(used) - 1))
    own = used[at] == feature if len(used) else np.zeros(len(feature), bool)
    doc, at, value = doc[own], at[own], np.log2(1 + count[own])
    grade = _grades(doc, at, value, toxic, len(used), l1)
    w, t = _descend(doc, at, value, grade, len(used), GRADES, steps, l1)
    keep = w != 0
    return Model(used[keep], w[keep], t + shift)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = SAMPLE_PER_CLASS, features_in_all: int = MOST_FEATURES) -> Model:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in tb.chunks(batch.column(0)):
                n = end - first
                keys = [row << BITS | bucket for bucket, row in features(data, bounds)]
                key, count = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
                at = pa.array(tb.row_starts(key >> BITS, n).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (key & ((1 << BITS) - 1), count)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, n) for k in (1, 2, 3)), *lists], names=["doc_id", "y", "of", "feature", "n"])

    sample = labelled_sample(labels, label, doc_id, per_class)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        # at most 2 x per_class ids are broadcast, and as many rows have a place
        held = scratch.settle(once(texts.join(F.broadcast(sample), "doc_id")).mapInArrow(tb.tidy(emit), "doc_id long, y int, of long, feature array<int>, n array<int>"))
        by_hash = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
        sizes = held.select("doc_id", "y", F.size("feature").cast("long").alias("size"))
        fits = sizes.withColumns({"upto": F.sum("size").over(by_hash), "nth": F.row_number().over(by_hash)}).where((F.col("upto") <= features_in_all // 2) | (F.col("nth") == 1)).select("doc_id")
        found = held.join(F.broadcast(fits), "doc_id").toArrow()
    ids, first = np.unique(found.column("doc_id").to_numpy(), return_index=True)
    found = found.take(pa.array(first))  # in order of id
    toxic = found.column("y").to_numpy() == 1
    if not toxic.any() or toxic.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES, 40.0))
    lists = found.column("feature").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(ids)), size)
    of = found.column("of").to_numpy()
    shift = np.log(of[~toxic][0] / (~toxic).sum()) - np.log(of[toxic][0] / toxic.sum())
    return train(doc, lists.flatten().to_numpy(), found.column("n").combine_chunks().flatten().to_numpy(), toxic, float(shift))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) of every row: expected grade, its rounding, P(grade >= 1), and whether that is a half or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            levels = np.zeros((batch.num_rows, GRADES))
            for first, end, data, bounds in tb.chunks(batch.column(1)):
                levels[first:end] = m.levels(m.linear(data, bounds))
            severity = levels.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(np.rint(severity).astype(np.int32)), pa.array(levels[:, 0]), pa.array(levels[:, 0] >= 0.5)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return ids.mapInArrow(tb.tidy(score), "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return predict(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
