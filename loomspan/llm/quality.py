"""Quality classifier: random-indexing word vectors and a two-layer network.

Random indexing: every token bucket has a sparse random vector of +1 and -1; the
vector of a bucket is the sum of its neighbours' random vectors over the whole
corpus, an integer sum that Spark adds up exactly in any order. A document is the
mean and spread of its tokens' vectors. A two-layer numpy network scores it, and a
temperature fitted on labelled rows kept from its training calibrates the score.

Tokens are runs of letters, digits or symbols in their own case, hashed to a fixed
number of buckets, so the vectors (buckets x dimensions) are broadcast at any scale.

Defined results: null and empty texts have the all-zero features and get the
network's score for them; without labels of both classes every score is the share
of label 1 (0.5 without labels). A document with several labels has their mean,
rounded up at one half; one with several texts is learned from once. Repeated rows get equal scores; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import fold_of, table

BUCKETS, DIMS, NONZERO, WINDOW = 1 << 14, 48, 4, 2
#: At most so many labelled documents of either class train the network; those of the lowest id hashes.
SAMPLE_PER_CLASS = 6000
_FLUSH = 1 << 19


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every token."""
    starts, ends, row = tb.runs(tb.KIND[data], bounds)
    if not len(starts):
        return np.zeros(0, np.int64), row
    return (tb.Prefix(data).of(starts, ends) >> tb.U64(64 - 14)).astype(np.int64), row


def random_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's random vector."""
    rng = np.random.default_rng(20240601)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def context_sums(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n, d0 ... ): how often a bucket occurs, and the sum of its neighbours' random vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = random_vectors()
        total, n = np.zeros(BUCKETS * DIMS, np.int64), np.zeros(BUCKETS, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            bucket = np.concatenate([b for b, _ in held])
            row = np.concatenate([r for _, r in held])
            held.clear()
            n[:] += np.bincount(bucket, minlength=BUCKETS)
            for gap in range(1, WINDOW + 1):
                near = row[gap:] == row[:-gap]
                left, right = bucket[:-gap][near], bucket[gap:][near]
                for a, b in ((left, right), (right, left)):
                    for j in range(NONZERO):
                        total[:] += np.bincount(a * DIMS + place[b, j], weights=sign[b, j], minlength=BUCKETS * DIMS).astype(np.int64)

        base = count = 0
        for batch in batches:
            for first, end, data, bounds in tb.chunks(batch.column(0)):
                bucket, row = tokens(data, bounds)
                held.append((bucket, row + base))
                base, count = base + end - first, count + len(bucket)
                if count >= _FLUSH:
                    flush()
                    count = 0
        if held:
            flush()
        at = np.flatnonzero(n)
        if len(at):
            rows = total.reshape(BUCKETS, DIMS)[at]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), *(pa.array(rows[:, d]) for d in range(DIMS))], names=["bucket", "n", *(f"d{d}" for d in range(DIMS))])

    schema = ", ".join(["bucket int", "n long", *(f"d{d} long" for d in range(DIMS))])
    sums = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tb.tidy(add), schema)
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMS)))


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vectors by bucket, float32; a bucket that never occurs has its own random vector."""
    place, sign = random_vectors()
    vectors = np.zeros((BUCKETS, DIMS))
    for j in range(NONZERO):
        np.add.at(vectors, (np.arange(BUCKETS), place[:, j]), sign[:, j])
    sums = context_sums(docs, text).toPandas()
    if len(sums):
        # the frequent neighbours' common direction is taken off, as it is in every vector
        rows = sums[[f"d{d}" for d in range(DIMS)]].to_numpy(np.float64)
        rows /= np.maximum(1, np.linalg.norm(rows, axis=1, keepdims=True))
        weight = sums["n"].to_numpy(np.float64)
        rows -= (rows * weight[:, None]).sum(axis=0) / weight.sum()
        vectors[sums["bucket"].to_numpy()] = rows * 2
    return (vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))).astype(np.float32)


GAPS = (1, 2, 3)


def pooled(vectors: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row for each text: mean and spread of its token vectors, their likeness at each gap, log length, norm of the mean."""
    bucket, row = tokens(data, bounds)
    texts = len(bounds) - 1
    at = tb.row_starts(row, texts)
    n = np.maximum(1, np.diff(at))[:, None]
    own = vectors[bucket]
    mean, square, like = np.zeros((texts, DIMS), np.float32), np.zeros((texts, DIMS), np.float32), np.zeros((texts, len(GAPS)))
    one = np.ones(int(n.max()), np.float32)
    for k, gap in enumerate(GAPS):
        near = np.zeros(len(bucket))
        near[gap:] = np.where(row[gap:] == row[:-gap], np.einsum("ij,ij->i", own[gap:], own[:-gap]), 0)
        like[:, k] = tb.sum_rows(near, at)
    for i in np.flatnonzero(np.diff(at)):  # a product with ones sums a text's rows far faster than reduceat
        x = own[at[i] : at[i + 1]]
        mean[i] = one[: len(x)] @ x
        square[i] = np.einsum("ij,ij->j", x, x)
    mean /= n
    spread = np.sqrt(np.maximum(0, square / n - mean * mean))
    return np.hstack([mean * 4, spread * 4, like / n * 2, np.log1p(np.diff(at))[:, None] / 4, 4 * np.linalg.norm(mean, axis=1, keepdims=True)]).astype(np.float32)


class Network:
    """Two layers: tanh, then one logit divided by a temperature."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.weights, self.temperature = prior, None, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 32, epochs: int = 60, step: float = 4e-3, decay: float = 1e-4) -> Network:
        rng = np.random.default_rng(7)
        kept = np.arange(len(y)) % 5 == 4
        if len(set(y[~kept])) < 2 or len(set(y[kept])) < 2:
            kept[:] = False
        tx, ty, tw = x[~kept].astype(np.float64), y[~kept], weight[~kept] / weight.mean()
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0]
        moments = [[np.zeros_like(v), np.zeros_like(v)] for v in p]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(ty))
            for i in range(0, len(order), 128):
                k = order[i : i + 128]
                h = np.tanh(tx[k] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - ty[k]) * tw[k] / len(k)
                back = np.outer(d, p[2]) * (1 - h * h)
                t += 1
                for j, g in enumerate((tx[k].T @ back, back.sum(axis=0), h.T @ d, d.sum())):
                    m = moments[j]
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    p[j] = p[j] - step * (m[0] / (1 - 0.9**t) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8) + decay * p[j])
        self.weights = tuple(p)
        if kept.any():
            z, target, tw = self.logits(x[kept].astype(np.float64)), y[kept], weight[kept]
            grid = np.geomspace(0.25, 8, 41)
            loss = [np.sum(tw * np.logaddexp(0, np.where(target > 0.5, -z, z) / c)) for c in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self


class Model:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network


def labelled_sample(labels: DataFrame, column: str, doc_id: str = "doc_id", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, y, rows of that class): at most per_class documents of either class, those of the lowest hashes."""
    one = labels.where(F.col(doc_id).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).withColumn("of", F.lit(sizes.get(y, 0)).cast("long")) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def once(found: DataFrame) -> DataFrame:
    """(text, doc_id, y, of): of a repeated document, the text of the least hash."""
    return found.groupBy("doc_id", "y", "of").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "doc_id", "y", "of")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Vectors from all docs; the network from a bounded sample of the labelled ones."""
    vectors = word_vectors(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in tb.chunks(batch.column(0)):
                rows = pooled(shared.value, data, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, end - first) for k in (1, 2, 3)] + [pa.array(list(rows), pa.list_(pa.float32()))], names=["doc_id", "y", "of", "x"])

    sample = labelled_sample(labels, label, doc_id)  # 2 x SAMPLE_PER_CLASS ids at most are broadcast
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = once(texts.join(F.broadcast(sample), "doc_id")).mapInArrow(tb.tidy(features), "doc_id long, y int, of long, x array<float>").toPandas().sort_values("doc_id")
    shared.unpersist()
    y = found["y"].to_numpy(np.float64)
    network = Network(float(y.mean()) if len(y) else 0.5)
    if len(set(y)) == 2:
        share = found.groupby("y")["of"].transform("first") / found.groupby("y")["of"].transform("size")
        network.fit(np.stack(found["x"]), y, share.to_numpy(np.float64))
    return Model(vectors, network)


def predict(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of docs and one named by ``score``; a column of that name is replaced."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score)
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, end, data, bounds in tb.chunks(batch.column(at)):
                out[first:end] = m.network.scores(pooled(m.vectors, data, bounds))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, score])

    return docs.mapInArrow(tb.tidy(rows), schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document's quality; labels of fold 1 of 3 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 3) != 1).select("doc_id", "quality")
    out = predict(docs, fit(docs, labels))
    return out.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
