"""Captions that are alike: signed hashed features, and the nearest of a vocabulary.

A caption's features are its words, its pairs of neighbouring words and its runs of three
letters; each adds or takes away one in the dimension that its hash names. Likeness is
the cosine of two such vectors, 1 for captions that are equal when normalised, 0 for
empty ones. Vectors are whole numbers, so equal captions are equally alike to the bit.

The nearest caption is found in blocks: a block of the vocabulary is a matrix of fixed
size that all tasks hold, and each batch of captions is one product with it. Nothing is
joined with everything, and no row leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import normalised

DIMENSIONS, ALIKE = 512, 0.8
#: Captions of a vocabulary that are held at once: 16 MB.
BLOCK = 1 << 14


def features(caption: str) -> list[str]:
    words = caption.split()
    whole = " ".join(words)
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)), *(whole[k : k + 3] for k in range(len(whole) - 2))]


@lru_cache(1 << 18)
def _place(feature: str) -> tuple[int, int]:
    """Dimension and sign of a feature."""
    raw = int.from_bytes(blake2b(feature.encode(), digest_size=8).digest(), "big")
    return raw % DIMENSIONS, -1 if raw >> 63 else 1


def vectors(captions: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts of each (normalised) caption, and their squared lengths."""
    captions = list(captions)
    out = np.zeros((len(captions), DIMENSIONS), np.int16)
    for row, caption in zip(out, captions, strict=True):
        for feature in features(caption):
            place, sign = _place(feature)
            row[place] += sign
    wide = out.astype(np.int64)
    return out, (wide * wide).sum(axis=1)


def likeness(left: str, right: str) -> float:
    """Of two normalised captions, 0 to 1."""
    if not left or not right:
        return 0.0
    if left == right:
        return 1.0
    (a, b), (x, y) = vectors([left, right])
    product = int(a.astype(np.int64) @ b.astype(np.int64))
    return 0.0 if not x or not y else max(0.0, min(1.0, product / float(np.sqrt(float(x) * float(y)))))


def _likeness(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([likeness(a or "", b or "") for a, b in zip(left, right, strict=True)])


def alike(left: Column, right: Column) -> Column:
    """How alike two captions are when normalised."""
    return F.pandas_udf(_likeness, "double")(normalised(left), normalised(right))


class Vocabulary:
    """Normalised captions in ascending order with their vectors."""

    def __init__(self, captions: Iterable[str]):
        self.captions = sorted({c for c in captions if c})
        counts, self.size = vectors(self.captions)
        self.matrix = counts.astype(np.float64).T

    def nearest(self, captions: list[str], least: float = ALIKE) -> list[tuple[float, str] | None]:
        """(likeness, caption) of the nearest for each (normalised) one, the greater of equally near ones; None if none is alike."""
        if not self.captions:
            return [None] * len(captions)
        known = set(self.captions)
        counts, size = vectors(captions)
        # whole numbers below 2**53 stay exact in doubles
        products = counts.astype(np.float64) @ self.matrix
        scores = np.clip(products / np.sqrt(np.maximum(1.0, size[:, None].astype(np.float64) * self.size[None, :])), 0, 1)
        scores[:, self.size == 0] = 0
        best = scores.shape[1] - 1 - np.argmax(scores[:, ::-1], axis=1)
        return [None if not c else (1.0, c) if c in known else (float(s[k]), self.captions[k]) if size[i] and s[k] >= least else None for i, (c, s, k) in enumerate(zip(captions, scores, best, strict=True))]


def _better(shared, least: float):
    """A function that keeps the better of a caption's best so far and its best in a block."""

    def better(captions: pd.Series, before: pd.Series, score: pd.Series) -> pd.DataFrame:
        texts = captions.fillna("").tolist()
        distinct = sorted(set(texts))
        found = dict(zip(distinct, shared.value.nearest(distinct, least), strict=True))
        rows = []
        for text, old, s in zip(texts, before, score, strict=True):
            both = [x for x in (found[text], None if old is None or pd.isna(s) else (float(s), old)) if x is not None]
            rows.append(max(both, default=(None, None)))
        return pd.DataFrame(rows, columns=["likeness", "nearest"], dtype=object)

    return better


def nearest_captions(df: DataFrame, caption: str, vocabulary: DataFrame, entry: str, least: float = ALIKE) -> DataFrame:
    """df and ``nearest`` (the normalised entry that is most alike, the caption's own if it is one; null below least) and ``likeness``.

    The vocabulary is read in blocks of a bounded size; a caption's best of all blocks is
    kept beside it from one block to the next. Null captions, and ones without letters
    when normalised, have none.
    """
    own = vocabulary.select(normalised(F.col(entry)).alias("entry")).where("entry <> ''").distinct()
    blocks = max(1, -(-own.count() // BLOCK))
    out = df.withColumns({"__caption": normalised(F.col(caption)), "nearest": F.lit(None).cast("string"), "likeness": F.lit(None).cast("double")})
    spark = df.sparkSession
    for k in range(blocks):
        part = [r[0] for r in own.where(F.pmod(F.xxhash64("entry"), F.lit(blocks)) == k).collect()]  # about BLOCK captions
        better = _better(spark.sparkContext.broadcast(Vocabulary(part)), least)
        out = out.withColumn("__best", F.pandas_udf(better, "likeness double, nearest string")("__caption", "nearest", "likeness")).withColumns({"nearest": F.col("__best.nearest"), "likeness": F.col("__best.likeness")})
    return out.drop("__caption", "__best")


def _closest(caption: pd.Series, candidates: pd.Series) -> pd.Series:
    return pd.Series([(Vocabulary(c if c is not None else []).nearest([t or ""])[0] or (0, None))[1] for t, c in zip(caption, candidates, strict=True)], dtype=object)


def closest(caption: Column, candidates: Column) -> Column:
    """The candidate, of an array in the row, that is most alike, normalised; null if none is."""
    return F.pandas_udf(_closest, "string")(normalised(caption), F.transform(candidates, normalised))


def canonical_states(caption: str, vocabulary: Vocabulary | None) -> str:
    """The vocabulary's caption that stands for a (normalised) one, or itself."""
    found = vocabulary.nearest([caption])[0] if vocabulary and caption else None
    return found[1] if found else caption

