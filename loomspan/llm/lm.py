"""Language-model scoring: a weighted backoff automaton of smoothed word n-grams.

Words, pairs and three words in a row of all training texts are counted exactly (by 56
bits of hash), every one of them. A word's probability after a context is smoothed by
the one after the context without its first word, as by that many further occurrences:
(n(context word) + K p(word after the shorter context)) / (n(context) + K), from the base
on. So the words of any context, and the unknown one, add up to one.

The automaton's states are the empty context and the one- and two-word contexts that
occur. The arcs of the n-grams that occur carry the log of that probability; a failure
arc leads to the context without its first word and carries log(K / (n(context) + K)),
which is what the smoothing leaves of it for words that don't occur there. The empty
state has the base weight of each word.

A text is read once from left to right: the state is carried, failure arcs are followed
until a word has an arc, the weights add up. Long texts are read in segments that start
two words early: the state depends on the last two words only.

Nothing of the corpus's size is broadcast or driven. Texts form blocks of about BLOCK
tokens. Each block ships its distinct n-grams, sorted by hash and packed, to ranges of
hashes, none where a range has none of its; a range adds up the counts of all blocks and
sends each block the counts of the n-grams that it asked for. From these the block builds its own part of the automaton:
the states and arcs that its texts can visit. Keys are spread evenly by hash and come
once a block, so no word or n-gram is hot. docs is read twice and has to give the same
rows in the same partitions both times, as files do; otherwise an error says so.

Defined results: null and empty texts are the end token alone. Without training texts
every token is unknown and weighs as in the base. Equal texts get equal results;
repeated rows stay; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import Scratch, fold_of, settle, table

#: K of one-word and of two-word contexts.
SMOOTHING = (150.0, 5.0)
#: Tokens of a block, and bytes of text for each range of hashes: what a task holds at once.
BLOCK, RANGE_BYTES = 1 << 20, 8 << 20
SEGMENT = 256
END = tb.U64(0x9D39247E33776D41)
KEY_BITS = 56
_SMALL = tb.U64(64 - KEY_BITS)


def sequences(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of [end, words, end] of each text, one after the other, and where each begins."""
    h, row = tb.words(data, bounds)
    n = len(bounds) - 1
    words = np.diff(tb.row_starts(row, n))
    start = np.concatenate([[0], np.cumsum(words + 2)])
    out = np.full(start[-1], END, tb.U64)
    inside = np.ones(len(out), bool)
    inside[start[:-1]] = inside[start[1:] - 1] = False
    out[inside] = h
    return out, start


def grams(seq: np.ndarray, start: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place of the last word, key) of every token, pair and three words in a row inside a text."""
    text = np.repeat(np.arange(len(start) - 1), np.diff(start))
    last = np.ones(len(seq), bool)
    last[start[:-1]] = False
    pair = tb.mix(tb.mix(seq[:-1] ^ tb.U64(2)) ^ seq[1:])
    triple = tb.mix(tb.mix(pair[:-1] ^ tb.U64(3)) ^ pair[1:])
    one, two, three = np.flatnonzero(last), np.flatnonzero(last[1:]), np.flatnonzero(text[:-2] == text[2:])
    return [(one, tb.mix(seq[one]) >> _SMALL), (two + 1, pair[two] >> _SMALL), (three + 2, triple[three] >> _SMALL)]


def _in_blocks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """(block, sequences, starts, ids, whether each is learned from), of whole texts with so many tokens or more; blocks are numbered by partition."""
    first = TaskContext.get().partitionId() << 32
    held: list[tuple] = []

    def block(k: int):
        starts, base = [np.zeros(1, np.int64)], 0
        for _, start, *_ in held:
            starts.append(start[1:] + base)
            base += start[-1]
        return first + k, np.concatenate([s for s, *_ in held]), np.concatenate(starts), pa.concat_arrays([i for *_, i, _ in held]), np.concatenate([t for *_, t in held])

    number = size = 0
    for batch in batches:
        learned = np.asarray(batch.column(2).to_pylist(), bool)
        for a, b, data, bounds in tb.chunks(batch.column(1)):
            held.append((*sequences(data, bounds), batch.column(0).slice(a, b - a), learned[a:b]))
            size += len(held[-1][0])
            if size >= tokens:
                yield block(number)
                held, size, number = [], 0, number + 1
    if held:
        yield block(number)


def _edges(parts: int) -> np.ndarray:
    """Where the ranges of hashes begin."""
    return np.array([(k << KEY_BITS) // parts for k in range(parts)], tb.U64)


def asked(texts: DataFrame, parts: int, tokens: int) -> DataFrame:
    """(block, part, k1, n1, k2, n2, k3, n3): a block's keys of each order in a range of hashes, and how often training texts of the block have them."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(parts)
        for block, seq, start, _, learned in _in_blocks(batches, tokens):
            own = np.repeat(learned, np.diff(start)).astype(tb.U64)
            columns, sizes = [], []
            for place, key in grams(seq, start):
                both = np.sort(key << tb.U64(1) | own[place])
                at = np.flatnonzero(np.concatenate([[True], both[1:] >> tb.U64(1) != both[:-1] >> tb.U64(1)])) if len(both) else np.zeros(0, np.int64)
                key = both[at] >> tb.U64(1)
                n = np.add.reduceat((both & tb.U64(1)).astype(np.int64), at) if len(at) else at
                cuts = [*np.searchsorted(key, edges), len(key)]
                sizes.append(np.diff(cuts))
                columns.append([tb.packed(np.diff(key[a:b], prepend=tb.U64(0)), "<u8") for a, b in zip(cuts, cuts[1:])])
                columns.append([tb.packed(n[a:b]) for a, b in zip(cuts, cuts[1:])])
            some = [k for k in range(parts) if any(filled[k] for filled in sizes)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), *(pa.array([c[k] for k in some], pa.binary()) for c in columns)], names=["block", "part", "k1", "n1", "k2", "n2", "k3", "n3"])

    return texts.mapInArrow(tb.tidy(ship), "block long, part int, k1 binary, n1 binary, k2 binary, n2 binary, k3 binary, n3 binary")


def answered(asked: DataFrame) -> DataFrame:
    """(block, part, c1, c2, c3): for each key that a block asked for, its count over all blocks; and a row of block -1 with the range's training ``tokens`` and ``distinct`` words."""

    def count(rows: pa.Table) -> pa.Table:
        out, distinct, total = [], 0, 0
        for order in (1, 2, 3):
            keys = [np.cumsum(tb.unpacked(x, "<u8"), dtype=tb.U64) for x in rows.column(f"k{order}").to_pylist()]
            every = np.concatenate(keys)
            n = np.concatenate([tb.unpacked(x) for x in rows.column(f"n{order}").to_pylist()]).astype(np.int64)
            by = np.argsort(every, kind="stable")
            every = every[by]
            at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            sums = np.add.reduceat(n[by], at) if len(at) else at
            if order == 1:
                distinct, total = int((sums > 0).sum()), int(sums.sum())
            n[by] = np.repeat(sums, np.diff(np.append(at, len(every))))
            cuts = np.cumsum([0, *map(len, keys)])
            out.append([tb.packed(n[a:b], "<u8") for a, b in zip(cuts, cuts[1:])] + [b""])
        tb.release()
        part = rows.column("part")[0].as_py()
        size = rows.num_rows
        return pa.table({"block": pa.array(rows.column("block").to_pylist() + [-1], pa.int64()), "part": pa.array([part] * (size + 1), pa.int32()), "tokens": pa.array([0] * size + [total], pa.int64()), "distinct": pa.array([0] * size + [distinct], pa.int64()), **{f"c{k + 1}": pa.array(c, pa.binary()) for k, c in enumerate(out)}})

    return asked.groupBy("part").applyInArrow(count, "block long, part int, tokens long, distinct long, c1 binary, c2 binary, c3 binary")


def payloads(texts: DataFrame, tokens: int) -> DataFrame:
    """(block, ids, learned, size, words, seq): each block's texts as places in its sorted list of word hashes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, seq, start, ids, learned in _in_blocks(batches, tokens):
            words, place = np.unique(seq, return_inverse=True)
            one = lambda x, kind: pa.array([x], kind)
            yield pa.RecordBatch.from_arrays(
                [one(block, pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(tb.packed(learned, "u1"), pa.binary()), one(tb.packed(np.diff(start)), pa.binary()), one(tb.packed(np.diff(words, prepend=tb.U64(0)), "<u8"), pa.binary()), one(tb.packed(place), pa.binary())],
                names=["block", "ids", "learned", "size", "words", "seq"],
            )

    return texts.mapInArrow(tb.tidy(write), "block long, ids array<long>, learned binary, size binary, words binary, seq binary")


class Automaton:
    """A block's states and arcs. State 0 is the empty context, 1 + w the word w, and 1 + words + p the pair p."""

    def __init__(self, n1: np.ndarray, a: np.ndarray, b: np.ndarray, n2: np.ndarray, first: np.ndarray, last: np.ndarray, c: np.ndarray, n3: np.ndarray, bulk: float, smoothing: tuple[float, float] = SMOOTHING):
        """n1: of each word; pairs (words a, b; count); three words (first pair, last pair, last word c; count); bulk: what the base divides by."""
        k1, k2 = smoothing
        single = np.where(n1 > 0, 1 + np.arange(len(n1)), 0)
        double = np.where(n2 > 0, 1 + len(n1) + np.arange(len(n2)), single[b])
        self.fail = np.concatenate([np.zeros(1 + len(n1), np.int64), single[b]])
        self.lost = np.log10(np.concatenate([[1.0], k1 / (n1 + k1), k2 / (n2 + k2)]))
        self.single = single
        p2 = (n2 + k1 * (n1[b] + 0.1) / bulk) / (n1[a] + k1)
        p3 = (n3 + k2 * p2[last]) / (n2[first] + k2)
        two, three = np.flatnonzero(n2), np.flatnonzero(n3)
        key = np.concatenate([single[a[two]] << 32 | b[two], double[first[three]] << 32 | c[three], [np.iinfo(np.int64).max]])
        by = np.argsort(key)
        self.key = key[by]
        self.log = np.log10(np.concatenate([p2[two], p3[three], [1.0]]))[by]
        self.next = np.concatenate([double[two], double[last[three]], [0]])[by]

    def read(self, words: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the weights of arcs and failure arcs of each text, and the places that fall to the empty state."""
        size = np.diff(start) - 1  # the first end is context only
        pieces = np.maximum(1, -(-size // SEGMENT))
        text = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = start[:-1][text] + nth * SEGMENT  # where the context of the segment's first place stands
        length = np.minimum(SEGMENT, size[text] - nth * SEGMENT)
        by = np.argsort(-length, kind="stable")
        begin, length, text, early = begin[by], length[by], text[by], nth[by] > 0
        total = np.zeros(len(text))
        # the first word of a text follows its end token; later segments warm up on one word more
        before = words[np.maximum(begin - 1, 0)]
        state, _ = self._step(np.where(early, self.single[before], 0), words[begin])
        live = len(text)
        empty = [np.zeros(0, np.int64)]
        for t in range(1, int(length.max(initial=0)) + 1):
            while live and length[live - 1] < t:
                live -= 1
            place = begin[:live] + t
            state[:live], (weight, at) = self._step(state[:live], words[place])
            total[:live] += weight
            empty.append(place[at])
        return np.bincount(text, weights=total, minlength=len(size)), np.concatenate(empty)

    def _step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The states after one word each; the weights met on the way, and which fell to the empty state."""
        now, after, weight = state.copy(), self.single[word], np.zeros(len(word))
        open_ = np.flatnonzero(now)
        while len(open_):
            key = now[open_] << 32 | word[open_]
            k = np.searchsorted(self.key, key)
            hit = self.key[k] == key
            done, k = open_[hit], k[hit]
            weight[done] += self.log[k]
            after[done] = self.next[k]
            now[done] = -1
            open_ = open_[~hit]
            weight[open_] += self.lost[now[open_]]
            now[open_] = self.fail[now[open_]]
            open_ = open_[now[open_] > 0]
        return after, (weight, np.flatnonzero(now == 0))


_READ = "doc_id long, learned boolean, n_tokens long, n_known long, base double, score double"


def read_block(payload: pa.Table, answers: pa.Table, bulk: float, smoothing: tuple[float, float]) -> pa.Table:
    """A row for each text of a block. bulk: what the base divides by."""
    (row,) = payload.to_pylist()
    words, place = np.cumsum(tb.unpacked(row["words"], "<u8"), dtype=tb.U64), tb.unpacked(row["seq"]).astype(np.int64)
    size, learned = tb.unpacked(row["size"]).astype(np.int64), tb.unpacked(row["learned"], "u1").astype(bool)
    start = np.concatenate([[0], np.cumsum(size)])
    seq = words[place]
    by = np.argsort(answers.column("part").to_numpy())
    n, where, which = [], [], []
    for order, (last, key) in enumerate(grams(seq, start), 1):
        blobs = answers.column(f"c{order}").to_pylist()
        counts = np.concatenate([np.zeros(0, np.int64), *(tb.unpacked(blobs[i], "<u8").astype(np.int64) for i in by)])
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(unique) != len(counts):
            raise RuntimeError("the table gave other rows when it was read again; write it first")
        n.append(counts)
        where.append(last[first])
        of = np.full(len(seq), -1, np.int64)
        of[last] = inverse
        which.append(of)
    n1 = np.zeros(len(words), np.int64)
    n1[place[where[0]]] = n[0]
    two, three = where[1], where[2]
    m = Automaton(n1, place[two - 1], place[two], n[1], which[1][three - 1], which[1][three], place[three], n[2], bulk, smoothing)
    weights, empty = m.read(place, start)
    texts = len(size)
    text = np.repeat(np.arange(texts), size)
    counted = np.ones(len(seq), bool)
    counted[start[:-1]] = False
    log = np.log10((n1 + 0.1) / bulk)
    sums = lambda at: np.bincount(text[at], weights=log[place[at]], minlength=texts).astype(np.float64)
    ids = payload.column("ids").combine_chunks().flatten()
    known = np.bincount(text[counted & (n1[place] > 0)], minlength=texts)
    out = pa.table({"doc_id": ids, "learned": pa.array(learned), "n_tokens": pa.array(size - 1), "n_known": pa.array(known), "base": pa.array(sums(np.flatnonzero(counted))), "score": pa.array(weights + sums(empty))})
    tb.release()
    return out


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", smoothing: tuple[float, float] = SMOOTHING, block: int = BLOCK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) of every row; the model is that of the rows where ``train`` holds."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("learned"))
    parts = max(1, -(-(narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // range_bytes))
    with Scratch(docs.sparkSession) as scratch:
        answers = scratch.settle(answered(asked(narrow, parts, block)))
        n, distinct = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct"))).first()
        bulk = n + 0.1 * (distinct + 1)
        told = answers.where("block >= 0").drop("tokens", "distinct")
        read = settle(payloads(narrow, block).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda payload, answers: read_block(payload, answers, bulk, smoothing), _READ))
    known = F.lit(n).cast("long").alias("train_tokens")
    return read.select("doc_id", "learned", "n_tokens", "n_known", known, F.col("base").alias("base_score"), "score")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; those of folds 1 to 9 of 10 are learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fold_of("doc_id", 10) != 0)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
