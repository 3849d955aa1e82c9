"""Sequence packing: best-fit start, then swap-based local search.

Texts become token ids with an end id; texts longer than a sequence are cut into
sequence-long pieces. Full pieces are sequences of their own. The others are dealt by
a hash of their row into shards of a bounded number of pieces, and each shard is packed
in one task: best fit by decreasing length, then moves that raise the sum of squared
fills - a document moves to a fuller bin, one is exchanged for a shorter one of it, or
two for one - until bins empty and no move is left. Shards lose at most their last bin
each, so the loss does not grow with the corpus.

Defined results: null and empty texts are one piece, the end id alone. Repeated rows are
packed each. Equal lengths are taken in the order of their row hash. An empty table
gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import settle, table

LENGTH = 2048
END = array("I", [0]).tobytes()
VOCABULARY = "word_bpe_49k.json"
#: Pieces of a shard on average: what one task holds and searches.
SHARD = 8192
SWEEPS = 24
#: Words of up to 64 letters that a worker remembers: some 20 MB.
MOST_WORDS = 1 << 17

_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# Fixed value: the vocabulary's own pre-token pattern, for the letters of _PLAIN.
_PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# Fixed value: the rest of that pattern, as the file writes it.
_OWN = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordIds(dict):
    """Little-endian 32-bit ids of words without white space, as bytes, remembered.

    The vocabulary's pre-tokens never cross white space, so a text's ids are its words'
    ids one after the other. Words of plain Latin letters and ASCII go to the tokenizer's
    model directly; all others through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most = most
        self.plain = self._alike()
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        # the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on
        self.alphabet = {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(rest)}}

    def _alike(self) -> bool:
        """Whether the file's own settings are those that the short way through the model stands for."""
        settings = json.loads(self.tokenizer.to_str())
        steps = [str(x.get("pattern", {}).get("Regex", "")) for x in (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        lower = any(x.get("type") == "Lowercase" for x in (settings.get("normalizer") or {}).get("normalizers", []))
        return lower and any(_OWN in x for x in steps)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        parts = [word] if word.isascii() and word.isalpha() and word.islower() else None
        if parts is None and _PLAIN.fullmatch(word) and "<|" not in word:
            parts = _PRE.findall(word.lower())
        if parts is None:
            found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes() if word else b""
        elif parts == [word]:
            found = array("I", [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet))]).tobytes()
        else:  # a part on its own is a word of the same ids
            found = b"".join([self[p] for p in parts])
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, text: str) -> bytes:
        """Ids of a text; of a vocabulary with other rules, by the tokenizer as a whole."""
        if not self.plain:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and end id, cut into pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(vocabulary or default_vocabulary())
        for batch in batches:
            out: list[tuple] = []
            for doc, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = ids.of(one.as_py() or "") + END
                for k, at in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[at : at + 4 * length]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [(), (), (), (), ()]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return ids.mapInArrow(tb.tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of places in lengths: by decreasing length, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g is set where a bin with gap g is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = open_gaps >> n
        if fitting:
            gap = n + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps ^= 1 << gap
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        by_gap[gap - n].append(b)
        open_gaps |= 1 << (gap - n)
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int, sweeps: int = SWEEPS) -> list[list[int]]:
    """Empty the least filled bins into the gaps of others by moves and exchanges, each raising the sum of squared fills."""
    lengths = lengths.astype(np.int64)
    home = np.empty(len(lengths), np.int64)
    for b, items in enumerate(bins):
        home[items] = b
    fill = np.bincount(home, weights=lengths, minlength=len(bins)).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    live = int((fill > 0).sum())

    def put(i: int, to: int) -> None:
        fill[home[i]] -= lengths[i]
        fill[to] += lengths[i]
        home[i] = to

    for _ in range(sweeps):
        if live <= least:
            break
        moved = False
        under = np.flatnonzero((fill > 0) & (fill < capacity))
        for source in under[np.argsort(fill[under], kind="stable")].tolist():
            if not 0 < fill[source] < capacity:
                continue
            while True:
                own = np.flatnonzero(home == source)
                if not len(own):
                    break
                own = own[np.argsort(-lengths[own], kind="stable")]
                # items of other bins with a gap; an exchange may only fill a bin at least as full as this one
                gap = capacity - fill
                open_to = (fill >= fill[source]) & (gap > 0) & (fill > 0)
                open_to[source] = False
                others = np.flatnonzero(open_to[home])
                targets = np.flatnonzero(open_to)
                if not len(targets):
                    break
                found = None
                for i in own.tolist():
                    fit = targets[gap[targets] >= lengths[i]]
                    if len(fit):
                        found = ((i,), None, int(fit[np.argmin(gap[fit])]))
                        break
                if not found:
                    best = 0
                    room = gap[home[others]]
                    pairs = [(int(a),) for a in own] + [(int(a), int(b)) for k, a in enumerate(own[:12]) for b in own[k + 1 : 12]]
                    for group in pairs:
                        gain = lengths[list(group)].sum() - lengths[others]
                        gain = np.where((gain > 0) & (gain <= room), gain, 0)
                        k = int(np.argmax(gain)) if len(gain) else 0
                        if len(gain) and gain[k] > best:
                            best, found = int(gain[k]), (group, int(others[k]), int(home[others[k]]))
                if not found:
                    break
                group, back, to = found
                if back is not None:
                    put(back, source)
                for i in group:
                    put(i, to)
                moved = True
            if fill[source] == 0:
                live -= 1
                if live <= least:
                    break
        if not moved:
            break
    order = np.lexsort((np.arange(len(home)), home))
    cuts = np.flatnonzero(np.diff(home[order])) + 1
    return [part.tolist() for part in np.split(order, cuts)] if len(order) else []


def pack(parts: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """parts (with a length of 1 to ``length``) and their sequence_id and offset."""
    parts = settle(parts.drop("sequence_id", "offset").withColumn("__row", F.monotonically_increasing_id()))
    kept = [c for c in parts.columns if c != "__row"]
    full = parts.where(F.col("length") >= length).select(*kept, (F.col("__row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = parts.where(F.col("length") < length)
    shards = max(1, -(-rest.count() // shard))
    dealt = rest.withColumn("__shard", F.pmod(F.xxhash64("__row"), F.lit(shards)))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__row").reset_index(drop=True)
        size = frame["length"].to_numpy()
        bins = local_search(size, best_fit(size, length), length)
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for b, items in enumerate(bins):
            sequence[items] = b
            offset[items] = np.cumsum(size[items]) - size[items]
        frame["sequence_id"] = (int(frame["__shard"].iloc[0]) << 32 | sequence) * 2 + 1
        frame["offset"] = offset
        return frame[[*kept, "sequence_id", "offset"]]

    return full.unionByName(dealt.groupBy("__shard").applyInPandas(one, full.schema))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return pack(pieces(table(spark, sf_dir, "documents")))
