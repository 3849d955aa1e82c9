"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every labelled text adds its n-grams of characters (small letters; all ASCII but letters
is one separator) to a count matrix of languages by hash buckets. The matrix has a fixed
number of cells (fewer buckets where there are more than MOST_LANGUAGES), so its
log-probabilities are broadcast whatever the corpus size; scoring gathers the rows of a
text's n-grams and adds them, all in numpy.

Defined results: a null text, or one without a letter, is ``und`` with score 0. With
nothing to learn from, every text is ``und``. Repeated rows are predicted alike.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import fold_of, table

BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
UNDETERMINED = "und"
#: With more languages, the buckets are folded so that the broadcast matrix stays as large.
MOST_LANGUAGES = 256


def characters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, with ASCII letters small and all other ASCII as 32, and the bounds counted in them."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.uint32)
    code = np.where(tb.LETTER[data[lead]], tb.LOWER[data[lead]], 32).astype(np.uint32)
    rest = np.concatenate([data, np.zeros(3, np.uint8)])
    for width, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
        at = np.flatnonzero((first >= low) & (first < high))
        if len(at):
            point = first[at] & bits
            for k in range(1, width):
                point = point << np.uint32(6) | (rest[lead[at] + k] & 0x3F)
            code[at] = point
    return code, np.searchsorted(lead, bounds)


def ngram_buckets(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of the n-grams that hold a letter, and their rows."""
    code, bounds = characters(data, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    gram, letter = code.astype(np.uint64), code != 32
    for n in range(2, max(ORDERS) + 1):
        if len(code) < n:
            return
        gram = gram[:-1] * tb.U64(0x9E3779B97F4A7C15) + code[n - 1 :]
        letter = letter[:-1] | (code[n - 1 :] != 32)
        if n in ORDERS:
            keep = letter & (row[: len(gram)] == row[n - 1 :])
            mixed = (gram[keep] ^ (gram[keep] >> tb.U64(29))) * tb.U64(0xBF58476D1CE4E5B9)
            yield (mixed >> tb.U64(49)).astype(np.int64), row[: len(gram)][keep]


def bucket_counts(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """(label, bucket, n) over all rows, and bucket -1 with the number of texts; summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.asarray(batch.column(1).to_pylist(), object)
            for first, end, data, bounds in tb.chunks(pc.utf8_lower(batch.column(0))):
                kinds, which = np.unique(names[first:end].astype(str), return_inverse=True)
                sums = [totals.setdefault(k, np.zeros(BUCKETS + 1, np.int64)) for k in kinds]
                for k, n in enumerate(np.bincount(which, minlength=len(kinds))):
                    sums[k][BUCKETS] += n
                for bucket, row in ngram_buckets(data, bounds):
                    both = np.bincount(which[row] * BUCKETS + bucket, minlength=len(kinds) * BUCKETS).reshape(len(kinds), BUCKETS)
                    for k in range(len(kinds)):
                        sums[k][:BUCKETS] += both[k]
        for name, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(counts[at])], names=["label", "bucket", "n"])

    return labelled.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")).mapInArrow(tb.tidy(count), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages, and float32 log-probabilities by language and bucket, a power of two of them."""

    def __init__(self, languages: list[str], prior: np.ndarray, logp: np.ndarray):
        self.languages, self.prior, self.logp = languages, prior, logp

    def buckets(self, bucket: np.ndarray) -> np.ndarray:
        return bucket & (self.logp.shape[1] - 1) if len(self.languages) > MOST_LANGUAGES else bucket


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", smoothing: float = 0.5) -> Model:
    counts = bucket_counts(labelled, text, label).toPandas()
    languages = sorted(counts["label"].unique())
    size = BUCKETS
    while size > 1 and size * len(languages) > BUCKETS * MOST_LANGUAGES:
        size //= 2
    sums, texts = np.full((size, len(languages)), smoothing), np.ones(len(languages))
    for k, name in enumerate(languages):
        own = counts[counts["label"] == name]
        at, n = own["bucket"].to_numpy(), own["n"].to_numpy()
        np.add.at(sums[:, k], at[at >= 0] & (size - 1), n[at >= 0])
        texts[k] = n[at < 0].sum()
    return Model(languages, np.log(texts / max(1, texts.sum())), np.ascontiguousarray(np.log(sums / sums.sum(axis=0)).T.astype(np.float32)))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row. The score is the posterior of the
    predicted language, with the evidence of n n-grams tempered by sqrt(n)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, end, data, bounds in tb.chunks(pc.utf8_lower(batch.column(1))):
                n = end - first
                total, grams = np.zeros((n, len(m.languages)), np.float64), np.zeros(n)
                for bucket, row in ngram_buckets(data, bounds):
                    bucket, at = m.buckets(bucket), tb.row_starts(row, n)
                    for k in range(len(m.languages)):
                        total[:, k] += tb.sum_rows(m.logp[k][bucket], at)
                    grams += np.diff(at)
                best[first:end] = -1
                if m.languages and n:
                    total += m.prior
                    p = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(grams, 1))[:, None])
                    best[first:end] = np.where(_has_letter(batch.column(1).slice(first, n), data, bounds), total.argmax(axis=1), -1)
                    score[first:end] = p.max(axis=1) / p.sum(axis=1)
            names = np.array([*m.languages, UNDETERMINED], object)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.where(best < 0, 0.0, score))], names=["doc_id", "lang_pred", "score"])

    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return ids.mapInArrow(tb.tidy(label), "doc_id long, lang_pred string, score double")


def _has_letter(column: pa.Array, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    ascii_letter = tb.LETTER[data] & (data < 128)
    found = tb.sum_rows(ascii_letter.astype(np.int64), bounds) > 0
    for i in np.flatnonzero(~found & (np.diff(bounds) > 0)):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return found


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language; documents of folds 0 and 2 of 3 with a language are learned from."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where((fold_of("doc_id", 3) != 1) & F.col("lang").isNotNull()).select("text", "lang"))
    held = docs.select(F.col("doc_id"), F.col("text"))
    out = predict(held, model)
    return out.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
